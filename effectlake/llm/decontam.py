"""Benchmark decontamination with a broadcast set of n-grams.

The benchmark's word windows become a table of distinct n-grams.  A document's
words are cut into blocks that lie side by side: a window of k words, wherever it
starts, holds a whole block of (k + 1) // 2 words.  So each text is cut into words
once, one hash per block meets the set of the hashes of all such runs of words in
the n-grams, and a document without a known block is clean.  The few others are
verified: their windows meet the n-grams themselves, word by word.

The set's size is measured; up to ``max_bytes`` it is broadcast, beyond that the same
join runs as a shuffle.  Texts are never shuffled, unless more documents are to be
dropped than may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns, fresh, stored, work_dir

#: Words of the lower-cased text: digits, a-z and all beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECES = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A benchmark with more bytes of n-grams than this isn't broadcast.
MAX_BYTES = 64 << 20
#: More documents than this aren't broadcast; each is 16 bytes.
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _grams(ws: Column, n: Column | int, size: Column) -> Column:
    """(at, gram) for each window of n words, at counted from 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.transform(F.sequence(F.lit(0), size - n), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(ws, i + 1, n), " ").alias("gram")))


def benchmark_grams(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """gram, its number of words and the ids of the items that hold it (as strings).  Items without words have none; items of fewer than n words are one gram."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    items = items.withColumn("k", F.least(F.size("ws"), F.lit(n)))
    each = items.select("item_id", "k", F.explode(_grams(F.col("ws"), F.col("k"), F.size("ws"))).alias("w"))
    return each.groupBy(F.col("w.gram").alias("gram"), "k").agg(F.collect_set("item_id").alias("items"))


def _covered(hits: Column) -> Column:
    """Number of words in the union of the windows of ``hits``, an array of (at, k)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(s: Column, h: Column) -> Column:
        end = h["at"] + h["k"]
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["n"] + F.greatest(F.lit(0), end - F.greatest(s["end"], h["at"]))).alias("n"))

    return F.aggregate(F.array_sort(hits), start, step, lambda s: s["n"])


def _copy_key() -> Column:
    """Tells apart rows of one doc_id with different texts."""
    return F.xxhash64("text")


def _blocks(ws: Column, b: int, step: int) -> Column:
    """A hash for the run of b words at each ``step``-th place."""
    last = F.size(ws) - b
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1, F.lit(step)), lambda i: F.xxhash64(F.lit(b), F.slice(ws, i, b)))).otherwise(F.array().cast("array<bigint>"))


def _suspects(docs: DataFrame, grams: DataFrame, sizes: list[int], scratch: str, broadcast: bool) -> tuple[DataFrame, DataFrame]:
    """All rows of docs as doc_id, copy_key, n_words, and id_, key_ of those with a block that is known."""
    ws = F.col("ws")
    blocks = F.concat(*[_blocks(ws, b, b) for b in sizes])
    cut = docs.select("doc_id", _copy_key().alias("copy_key"), words(F.col("text")).alias("ws"))
    cut = stored(cut.select("doc_id", "copy_key", F.size("ws").cast("long").alias("n_words"), blocks.alias("blocks")), f"{scratch}/blocks")
    gram = grams.select("k", F.split("gram", " ").alias("ws"))
    known = F.concat(*[F.when(F.floor((F.col("k") + 1) / 2) == b, _blocks(ws, b, 1)).otherwise(F.array().cast("array<bigint>")) for b in sizes])
    known = gram.select(F.explode(known).alias("h")).distinct()
    found = cut.select(F.col("doc_id").alias("id_"), F.col("copy_key").alias("key_"), F.explode("blocks").alias("h"))
    found = found.join(F.broadcast(known) if broadcast else known, "h", "left_semi").select("id_", "key_").distinct()
    return cut.drop("blocks"), stored(found, f"{scratch}/suspects")


def _windows(ws: Column, k: int) -> Column:
    """(at, k, gram) for each window of k words; none in a shorter text."""
    named = F.transform(_grams(ws, k, F.size(ws)), lambda w: F.struct(w["at"].alias("at"), F.lit(k).alias("k"), w["gram"].alias("gram")))
    return F.when(F.size(ws) >= k, named).otherwise(F.array().cast("array<struct<at:int,k:int,gram:string>>"))


def _same_row(id_: str = "id_", key: str = "key_") -> Column:
    return F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("copy_key") == F.col(key))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = MAX_BYTES, scratch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, copy_key, n_words, hits (array of at, k), n_hit, items.

    copy_key identifies the text, so that rows that repeat a doc_id with another
    text are told apart; rows that repeat both get the same result.  A null or
    wordless text has no words and no hits.  A benchmark without words hits nothing."""
    scratch = scratch or work_dir(docs.sparkSession)
    grams = stored(benchmark_grams(benchmark, n), f"{scratch}/grams")
    lengths = sorted(r[0] for r in grams.select("k").distinct().collect())  # at most n numbers
    size = grams.agg(F.sum(F.octet_length("gram") + 32 + F.aggregate("items", F.lit(0), lambda a, i: a + F.octet_length(i) + 16))).first()[0] or 0
    none = F.array().cast("array<struct<at:int,k:int>>")
    if not lengths:
        n_words = F.coalesce(F.regexp_count(ascii_lower(F.col("text")), F.lit(WORDS)), F.lit(0)).cast("long")
        return docs.select("doc_id", _copy_key().alias("copy_key"), n_words.alias("n_words"), none.alias("hits"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    base, suspects = _suspects(docs, grams, sorted({(k + 1) // 2 for k in lengths}), scratch, size <= max_bytes)
    few = suspects.count() <= BROADCAST_IDS
    own = docs.select("doc_id", _copy_key().alias("copy_key"), "text").join(F.broadcast(suspects) if few else suspects, _same_row(), "left_semi").dropDuplicates(["doc_id", "copy_key"])
    own = own.select("doc_id", "copy_key", words(F.col("text")).alias("ws"))
    each = F.flatten(F.array(*[_windows(F.col("ws"), k) for k in lengths]))
    windows = own.select("doc_id", "copy_key", F.explode(each).alias("w")).select("doc_id", "copy_key", F.col("w.at").alias("at"), F.col("w.k").alias("k"), F.col("w.gram").alias("gram"))
    found = windows.join(F.broadcast(grams) if size <= max_bytes else grams, ["gram", "k"])
    per_doc = found.groupBy("doc_id", "copy_key").agg(
        F.collect_set(F.struct("at", "k")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    per_doc = stored(
        per_doc.select(F.col("doc_id").alias("id_"), F.col("copy_key").alias("key_"), "hits", _covered(F.col("hits")).cast("long").alias("n_hit"), "items"), f"{scratch}/hits"
    )
    both = base.join(F.broadcast(per_doc) if few and _bytes_of(per_doc) <= max_bytes else per_doc, _same_row(), "left")
    return both.select(
        "doc_id", "copy_key", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _bytes_of(per_doc: DataFrame) -> int:
    return per_doc.agg(F.sum(F.lit(64) + 8 * F.size("hits") + F.aggregate("items", F.lit(0), lambda a, i: a + F.octet_length(i) + 16))).first()[0] or 0


def report(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _hit_rows(docs: DataFrame, benchmark: DataFrame, n: int, *more: str) -> tuple[DataFrame, DataFrame, Column]:
    """docs with a hidden key, the hit ones by id and key (broadcast where they are few), and when the two match."""
    key, id_, key_ = fresh(docs, "key", "id_", "key_")
    hits = scan(docs, benchmark, n).where(F.col("n_hit") > 0).select(F.col("doc_id").alias(id_), F.col("copy_key").alias(key_), *more).dropDuplicates([id_, key_])
    hits = stored(hits, f"{work_dir(docs.sparkSession)}/hit")
    small = hits.count() <= BROADCAST_IDS and (not more or _bytes_of(hits.withColumn("items", F.array().cast("array<string>"))) <= MAX_BYTES)
    own = docs.withColumn(key, _copy_key())
    return own, F.broadcast(hits) if small else hits, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(key_))


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Rows of ``docs`` without any hit, all columns as they are.

    A null or wordless text has no hit and stays; repeated rows go or stay together, by
    their text; a benchmark without words drops nothing; no rows give none."""
    own, bad, same = _hit_rows(docs, benchmark, n)
    return own.join(bad, same, "left_anti").select(*columns(docs))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` with the words that are hit cut out of the text; all else, separators included, stays."""
    (found,) = fresh(docs, "hits")
    own, hits, same = _hit_rows(docs, benchmark, n, "hits")
    both = own.join(hits.withColumnRenamed("hits", found) if found != "hits" else hits, same, "left")
    # Case matters not for where words lie: lower-casing A-Z changes no length.
    pieces = F.regexp_extract_all(F.col("text"), F.lit(PIECES.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")), F.lit(0))
    first_is_word = F.col("text").rlike("^" + WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))
    turn = F.when(first_is_word, 0).otherwise(1)
    kept = F.filter(
        pieces,
        lambda _, i: ((i + turn) % 2 == 1)
        | ~F.exists(F.col(found), lambda h: (h["at"] <= F.floor((i - turn + 1) / 2)) & (F.floor((i - turn + 1) / 2) < h["at"] + h["k"])),
    )
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return both.select(*[text.alias(c) if c == "text" else own for c, own in zip(docs.columns, columns(docs), strict=True)])
