"""Exact ranks and quantiles without a task that sees all values.

Rows are first counted by value.  Values are dealt into ranges between the least
and the greatest of their segment; running totals over the ranges, a bounded
number of rows, give what lies before each, and only values of one range are
ordered together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .moments import each_row, grouped, join_by, number, types

#: Ranges that the values of a segment are cut into.
RANGES = 4096
#: Segments of up to so many distinct values are ranked by a window of their own; larger ones are first narrowed to brackets.
WINDOW = 1_000_000
#: Parts that the sketch of a distribution tells apart.
ACCURACY = 10_000


def place(c: Column, ends: Sequence[float], below: bool = False) -> Column:
    """How many of the sorted ``ends`` are at most c, or with ``below`` less than it, by halving; 0 for a null."""

    def halved(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        first = c <= float(ends[mid]) if below else c < float(ends[mid])
        return F.when(first, halved(low, mid)).otherwise(halved(mid + 1, high))

    return F.when(c.isNull(), 0).otherwise(halved(0, len(ends)))


def _held(table: DataFrame, by: Sequence[str], shape: str) -> DataFrame:
    """A table of a row per segment, worked out once: few segments are broadcast to their rows, which then need no sort by a key of few values."""
    return each_row(table, lambda r: r, ", ".join([*types(table, by), shape]))


def _ranged(values: DataFrame, v: str, by: Sequence[str]) -> DataFrame:
    """values and range: the place of v among RANGES equal parts, by approximate quantiles so that no part holds most values."""
    ends = grouped(values, by, F.percentile_approx(v, [k / 64 for k in range(65)], 2_000).alias("ends_"), F.min(v).alias("lo_"), F.max(v).alias("hi_"))
    both = join_by(values, _held(ends, by, "ends_ array<double>, lo_ double, hi_ double"), by)
    part = F.size(F.filter("ends_", lambda e: e < F.col(v)))
    below, above = F.coalesce(F.get("ends_", part - 1), F.col("lo_")), F.coalesce(F.get("ends_", part), F.col("hi_"))
    fine = F.when(above > below, F.floor((F.col(v) - below) / (above - below) * (RANGES // 64))).otherwise(0)
    return both.withColumn("range_", part * (RANGES // 64) + F.least(F.greatest(fine, F.lit(0)), F.lit(RANGES // 64 - 1))).drop("ends_", "lo_", "hi_")


def running(values: DataFrame, v: str, k: str, by: Sequence[str] = ()) -> DataFrame:
    """values (by..., v, k: a row per distinct value and its count) and before: the count of all smaller values of the segment."""
    placed = _ranged(values, v, by)
    parts = placed.groupBy(*by, "range_").agg(F.sum(k).alias("part_"))
    over = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a segment at most
    parts = parts.select(*by, "range_", F.coalesce(F.sum("part_").over(over), F.lit(0)).alias("lower_"))
    own = Window.partitionBy(*by, "range_").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("own_", F.coalesce(F.sum(k).over(own), F.lit(0)))
    return join_by(ranked, parts, [*by, "range_"]).withColumn("before", F.col("lower_") + F.col("own_")).drop("range_", "lower_", "own_")


def quantiles(df: DataFrame, x: str | Column, taus: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by..., q: the exact quantiles of x with linear interpolation, an array in order of ``taus``; nulls are left out.

    Where no segment has over WINDOW values that differ, about, one window ranks each.  Else a sketch
    brackets each quantile: two parts in ACCURACY on either side, where its own error is
    one.  The next pass counts what lies below each bracket and takes the values in it,
    which alone are ranked.  Segments of few rows are one bracket."""
    k, slack = len(taus), 2 / ACCURACY
    rows = df.select(*by, number(x).alias("v")).where("v IS NOT NULL")
    most = grouped(rows, by, F.least(F.count(F.lit(1)), F.approx_count_distinct("v")).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= WINDOW:
        values = rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("k"))
        own = Window.partitionBy(*by)
        each = values.select("*", (F.sum("k").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).alias("before"), F.sum("k").over(own).alias("total_"))
        at = [F.lit(float(t)) * (F.col("total_") - 1) for t in taus]
        pick = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("k")), F.col("v")))
        found = grouped(each, by, *[c.alias(f"{n}{i}") for i, p in enumerate(at) for n, c in (("a", pick(F.floor(p))), ("b", pick(F.ceil(p))))], F.max("total_").alias("total_"))
        return found.select(*by, F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (p - F.floor(p)) for i, p in enumerate(at)]).alias("q"))
    ends = [*[max(t - slack, 0.0) for t in taus], *[min(t + slack, 1.0) for t in taus]]
    first = grouped(rows, by, F.percentile_approx("v", ends, ACCURACY).alias("e"), F.count(F.lit(1)).alias("total_"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    few = F.col("total_") <= 10 * ACCURACY
    low = [F.when(few | F.lit(t <= slack), F.col("lo")).otherwise(F.col("e")[i]) for i, t in enumerate(taus)]
    high = [F.when(few | F.lit(t >= 1 - slack), F.col("hi")).otherwise(F.col("e")[k + i]) for i, t in enumerate(taus)]
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), a.alias("lo"), b.alias("hi")) for i, (a, b) in enumerate(zip(low, high, strict=True))])
    first = _held(first.select(*by, "total_", brackets.alias("bs")), by, "total_ long, bs array<struct<i: int, lo: double, hi: double>>")
    both = join_by(rows, first.select(*by, "bs"), by)
    below = grouped(both, by, F.array(*[F.count_if(F.col("v") < F.col("bs")[i]["lo"]) for i in range(k)]).alias("below_"))
    inside = both.select(*by, "v", F.explode(F.filter("bs", lambda b: F.col("v").between(b["lo"], b["hi"]))).alias("b"))
    values = inside.groupBy(*by, F.col("b.i").alias("i"), "v").agg(F.count(F.lit(1)).alias("k"))
    each = join_by(running(values, "v", "k", [*by, "i"]), join_by(first.select(*by, "total_"), below, by), by)
    each = each.withColumn("before", F.col("before") + F.col("below_")[F.col("i")])
    place = [F.lit(float(t)) * (F.col("total_") - 1) for t in taus]
    holds = lambda i, at: F.max(F.when((F.col("i") == i) & (F.col("before") <= at) & (at < F.col("before") + F.col("k")), F.col("v")))
    found = grouped(each, by, *[a.alias(f"{n}{i}") for i, p in enumerate(place) for n, a in (("a", holds(i, F.floor(p))), ("b", holds(i, F.ceil(p))))], F.max("total_").alias("total_"))
    return found.select(*by, F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]).alias("q"))


def weighted_quantiles(groups: DataFrame, values: DataFrame, taus: Sequence[float], by: Sequence[str]) -> DataFrame:
    """by..., q: quantiles of values counted with whole-number weights, each value as often as its weight, with linear interpolation; null where ``values`` lack one.

    ``groups`` has by..., total (the sum of weights) and below, an array over ``taus`` of
    the weights of values smaller than any given for it; ``values`` has by..., i (the
    place in ``taus``), v and k (the weight), a row per distinct value."""
    each = join_by(running(values.where("k > 0"), "v", "k", [*by, "i"]), _held(groups.select(*by, "total", "below"), by, "total long, below array<long>"), by)
    each = each.withColumn("before", F.col("before") + F.col("below")[F.col("i")])
    at = [F.lit(float(t)) * (F.col("total") - 1) for t in taus]
    holds = lambda i, p: F.max(F.when((F.col("i") == i) & (F.col("before") <= p) & (p < F.col("before") + F.col("k")), F.col("v")))
    found = grouped(each, by, *[x.alias(f"{n}{i}") for i, p in enumerate(at) for n, x in (("a", holds(i, F.floor(p))), ("b", holds(i, F.ceil(p))))], F.max("total").alias("total"))
    return found.select(*by, F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (p - F.floor(p)) for i, p in enumerate(at)]).alias("q"))
