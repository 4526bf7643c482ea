"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words.  A document of a source with target t
and size s (in words) should be taken t/s times; the whole part is taken for
certain, and what is left is a fraction to be rounded to 0 or 1 so that the
source's total in words stays put.  Pivotal rounding does it by pairs: words are
moved between two documents, at random in one of two directions, just as many as
make one of the two fractions 0 or 1; the other goes on to the next pair.  The
chances of the directions are such that each document's expectation is its
fraction.  It runs as a reduction tree: documents are dealt by hash into small
blocks, a block rounds all but one of its documents, and the ones left over
are dealt into blocks again, until one is left per source.  That one is rounded
to the nearer side, so a source misses its target by less than one document.
No block holds more than a few hundred documents however large the source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns, fresh, shuffle_parts, stored, work_dir

#: Documents that share a block of the tree, on average.
BLOCK = 64
#: No document is taken more often than this.
MAX_COPIES = 3
#: A table of so many sources at most is broadcast to the documents.
BROADCAST_SOURCES = 100_000
#: The weights that sources get in order of their names.
WEIGHT_CYCLE = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, cycle: tuple[int, ...] = WEIGHT_CYCLE) -> DataFrame:
    """source, weight: the weights in turn over the sources by code point, null last.  One row per source passes through the window."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.lit(list(cycle)), (rank % len(cycle) + 1).cast("int")).cast("double").alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target, n_items.

    All sizes are shared out by weight; a target stops at ``most`` times its
    source's size and the excess goes to the others by weight.  In order of
    most * size / weight the sources that stop come first, so running sums give
    the share of the rest at once."""
    given = weights.select(F.col("source").alias("source_"), "weight")
    both = sizes.join(given, F.col("source").eqNullSafe(F.col("source_"))).select("source", "source_size", "n_items", "weight")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = most * F.col("source_size")
    both = both.select(
        "*", cap.cast("double").alias("cap"), F.row_number().over(order).alias("k"),
        (
            (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
            / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    both = both.withColumn("stops", F.col("cap") <= F.col("weight") * F.col("level"))
    rest = F.min_by(F.when(~F.col("stops"), F.col("level")), F.when(~F.col("stops"), F.col("k"))).over(every)
    return both.select("source", "source_size", "n_items", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * rest).alias("target"))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _pair(seed: int, level: int, fields: list[str]):  # noqa: ANN202
    def with_p(x: Column, p: Column) -> Column:
        return F.struct(*[x[f].alias(f) for f in fields if f != "p"], p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        a = state["cur"]
        chance = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), a["doc_id"], a["size"], x["doc_id"], x["size"]), F.lit(1 << 53)) / F.lit(float(1 << 53))
        up = F.least(a["size"] * (1 - a["p"]), x["size"] * x["p"])
        down = F.least(a["size"] * a["p"], x["size"] * (1 - x["p"]))

        def settle(v: Column) -> Column:
            moved = F.when(chance * (v["up"] + v["down"]) < v["down"], v["up"]).otherwise(-v["down"])
            return _let(F.struct((a["p"] + moved / a["size"]).alias("pa"), (x["p"] - moved / x["size"]).alias("px")), ended)

        def ended(p: Column) -> Column:
            def snap(q: Column) -> Column:
                return F.when(q < 1e-9, 0.0).when(q > 1 - 1e-9, 1.0).otherwise(q)

            return _let(F.struct(snap(p["pa"]).alias("pa"), snap(p["px"]).alias("px")), kept)

        def kept(p: Column) -> Column:
            whole = lambda q: (q == 0.0) | (q == 1.0)
            two = F.array(with_p(a, p["pa"]), with_p(x, p["px"]))
            return F.struct(
                F.when(~whole(p["pa"]), with_p(a, p["pa"])).when(~whole(p["px"]), with_p(x, p["px"])).alias("cur"),
                F.concat(state["done"], F.filter(two, lambda y: whole(y["p"]))).alias("done"),
            )

        return F.when(a.isNull(), F.struct(x.alias("cur"), state["done"].alias("done"))).otherwise(
            _let(F.struct(up.alias("up"), down.alias("down")), settle)
        )

    return step


def round_copies(items: DataFrame, largest: int, scratch: str, seed: int = 0) -> DataFrame:
    """items: source, n_items, doc_id, size, m, whole, p with 0 < p < 1 and size > 0.  The same rows with p 0 or 1.

    largest: the number of items of the largest source."""
    fields = ["doc_id", "size", "m", "whole", "p"]
    item_type = "struct<doc_id:bigint,size:bigint,m:bigint,whole:bigint,p:double>"
    done, level, blocks = [], 0, F.col("n_items")
    while True:
        blocks, largest = F.ceil(blocks / BLOCK), -(-largest // BLOCK)
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), blocks)
        # The order within a block is fixed: sizes falling, so that what is left over tends to be small.
        order = [(-F.col("size")).alias("o"), F.xxhash64(F.lit(seed), "doc_id").alias("h")]
        lists = items.groupBy("source", "n_items", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("xs"))
        start = F.struct(F.lit(None).cast(item_type).alias("cur"), F.array().cast(f"array<{item_type}>").alias("done"))
        xs = F.transform("xs", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
        rounded = stored(lists.select("source", "n_items", F.aggregate(xs, start, _pair(seed, level, fields)).alias("r")), f"{scratch}/level{level}")
        done.append(rounded.select("source", F.explode("r.done").alias("x")).select("source", "x.*"))
        left = rounded.where(F.col("r.cur").isNotNull()).select("source", "n_items", "r.cur.*")
        if largest <= 1:
            last = left.drop("n_items").withColumn("p", F.when(F.col("p") < 0.5, 0.0).otherwise(1.0))
            return reduce(DataFrame.unionByName, [*done, last])
        items, level = left, level + 1


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 0, scratch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, source, nth.

    docs: doc_id, text, source; weights: source, weight (default: 5, 2, 1 in turn).
    Rows alike in doc_id, source and size are one item with that many copies to
    give out; nth numbers them from 1.  A null text has no words and takes none;
    null is a source of its own.  The same input gives the same result."""
    scratch = scratch or work_dir(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    items = stored(sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")), f"{scratch}/items")
    # Added up in two steps: a source may hold a third of all rows.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(shuffle_parts(docs.sparkSession)))
    sizes = items.groupBy("source", part.alias("part")).agg(F.sum(F.col("size") * F.col("m")).alias("s"), F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("source").agg(F.sum("s").alias("source_size"), F.sum("c").alias("n_items"))
    plan = stored(targets(sizes, weights if weights is not None else cycle_weights(sizes.select("source"))), f"{scratch}/targets")
    n, largest = plan.agg(F.count(F.lit(1)), F.coalesce(F.max("n_items"), F.lit(0))).first()
    known = plan.withColumnRenamed("source", "source_")
    if n <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    mass = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    split = items.join(known, F.col("source").eqNullSafe(F.col("source_"))).select("source", "n_items", "doc_id", "size", "m", mass.alias("mass"))
    whole = F.when(F.col("mass") - F.floor("mass") > 1 - 1e-9, F.ceil("mass")).otherwise(F.floor("mass")).cast("long")
    split = split.select("source", "n_items", "doc_id", "size", "m", whole.alias("whole"), F.greatest(F.col("mass") - whole, F.lit(0.0)).alias("p"))
    open_ = (F.col("p") > 1e-9) & (F.col("size") > 0)
    settled = split.where(~open_).withColumn("p", F.lit(0.0)).drop("n_items")
    rounded = settled.unionByName(round_copies(split.where(open_), largest, scratch, seed))
    total = F.least(F.col("whole") + F.col("p").cast("long"), MAX_COPIES * F.col("m"))
    rows = rounded.select("source", "doc_id", "size", "m", total.alias("total"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("nth"))
    copies = F.floor(F.col("total") / F.col("m")) + (F.col("nth") <= F.col("total") % F.col("m")).cast("long")
    rows = rows.select("source", "doc_id", "size", "nth", copies.alias("copies"))
    return rows.join(known, F.col("source").eqNullSafe(F.col("source_"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source", "nth"
    )


def mix_documents(docs: DataFrame, weights: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns as they are.

    A null or wordless text has size 0 and is never taken; a null source is a source of
    its own; rows that repeat an id, a source and a size are told apart by their texts'
    hashes, and repeated rows each have copies of their own; no rows give none."""
    id_, source_, size_, nth_, size, nth, copies, copy = fresh(docs, "id_", "source_", "size_", "nth_", "size__", "nth__", "copies", "copy__")
    plan = mix(docs, weights, seed).where(F.col("copies") > 0).select(
        F.col("doc_id").alias(id_), F.col("source").alias(source_), F.col("size").alias(size_), F.col("nth").alias(nth_), F.col("copies").alias(copies)
    )
    own = docs.withColumn(size, n_words(F.col("text"))).withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source_)) & (F.col(size) == F.col(size_)) & (F.col(nth) == F.col(nth_))
    return own.join(plan, same).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*columns(docs))
