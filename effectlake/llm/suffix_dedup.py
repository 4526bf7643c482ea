"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Suffixes that matter.  Of the 32-byte strings within each window of ``LENGTH``
bytes, the one with the least hash (the leftmost, at a tie) is the window's
anchor.  Equal windows have equal anchors at equal places, so a suffix array of
the anchors alone, one byte position in about 85, finds every long match.  A
window belongs to one anchor, and an anchor's windows are neighbours.

Family.  The suffix array of a batch holds the suffixes that start at its anchors,
in order of their first 32 bytes: the place of the first, how many begin alike,
and whether all of those have the same context, that is the same bytes over all
windows of the anchor.  Suffixes that begin alike are one entry; so a string in a
third of all documents is one row.  Arrays are tables bucketed and sorted by those
bytes.  A new batch's array is merge-scanned against every level, which gives the
long matches of the batch, and only then becomes a level itself; levels of about
one size are merged into one, so an entry is rewritten a logarithmic number of
times.  The levels are listed in a manifest beside them, and any session opens the
family again by its path.

Matches.  Where all contexts of a string agree (by a 64-bit BLAKE2 digest), every
window of theirs is repeated.  Elsewhere one copy of each context is compared window
by window: candidates by hash, and then the bytes themselves.  What repeated windows
cover is removed.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_parts, stored, work_dir
from .textbytes import _BASE, _VALUE, hash_between, mix, powers, slices

LENGTH, GRAM = 200, 32
#: Batches that a set of documents is taken in.
BATCHES = 3
#: Levels are merged when the older has fewer entries than this many times the newer.
RATIO = 1.5
#: Strings with more contexts than this are compared by a shuffle of window hashes, not in one task.
CONTEXTS = 20_000
#: More documents than this aren't broadcast; each is 12 bytes.
BROADCAST_IDS = 1_000_000
#: Strings with over this part of all anchors meet their rows by broadcast: there are no more than that many of them.
HOT_STRINGS = 4096
_OTHER_BASE = 0xD6E8FEB86659FD93
ANCHOR = "doc_id long, tk int, at int, lo int, hi int, gram binary, ctx long"
ENTRY = "gram binary, n long, ctx long, doc_id long, at int"


def prefix_hash(data: np.ndarray) -> np.ndarray:
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(_BASE, len(data)), out=h[1:])
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    return np.minimum(ahead, np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document number, place in it, first and last window, the string and a digest of the context, for each anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return (none,) * 6
    h = prefix_hash(data)
    place = np.arange(len(data) - GRAM + 1)
    gram = hash_between(h, place, place + GRAM)
    least = sliding_min((gram >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64), LENGTH - GRAM + 1)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    p = np.flatnonzero(np.arange(len(least)) + LENGTH <= end)
    if not len(p):
        return (none,) * 6
    at = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    lo, hi, at = p[first], p[np.append(first[1:], len(p)) - 1], at[first]
    raw = data.tobytes()
    ctx = [
        hashlib.blake2b(raw[a : b + LENGTH], digest_size=8, salt=struct.pack("<II", c - a, b - a)).digest() for a, b, c in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)
    ]
    doc = np.searchsorted(offsets, at, "right") - 1
    base = offsets[doc]
    return doc, at - base, lo - base, hi - base, data[at[:, None] + np.arange(GRAM)], np.frombuffer(b"".join(ctx), np.int64)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """docs: doc_id, tk (a hash of the text), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("tk")
            for row, data, offsets in slices(batch.column("text")):
                doc, *places, strings, ctx = anchors(data, offsets)
                if len(doc):
                    take = pa.array(doc + row)
                    bounds = pa.py_buffer(np.arange(0, GRAM * len(doc) + 1, GRAM, dtype=np.int32))
                    gram = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, bounds, pa.py_buffer(np.ascontiguousarray(strings))])
                    yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), *[pa.array(x.astype(np.int32)) for x in places], gram, pa.array(ctx)], ["doc_id", "tk", "at", "lo", "hi", "gram", "ctx"])

    return docs.mapInArrow(run, ANCHOR)


class IndexFamily:
    """Sparse suffix arrays of geometrically growing sizes, in files under ``path``.

    An entry: gram (the suffix's first 32 bytes, by which arrays are sorted), n (how
    many suffixes begin so), ctx (their one context, or null), and the place of the
    first: doc_id, at.  A level that was merged into another is emptied."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Opens the family under ``path``, or begins one of ``buckets`` buckets there."""
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or max(8, shuffle_parts(spark))
        self.turn, self.levels = 0, []  # (entries, table), the largest first
        try:
            last = spark.read.schema("turn long, buckets int, levels array<struct<rows:long,name:string>>").json(f"{self.path}/manifest/*").orderBy(F.col("turn").desc()).first()
        except AnalysisException:
            last = None
        if last is not None:
            self.turn, self.buckets, self.levels = last["turn"], last["buckets"], [(x["rows"], x["name"]) for x in last["levels"]]
            for _, name in self.levels:
                if not spark.catalog.tableExists(name):
                    spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet CLUSTERED BY (gram) SORTED BY (gram) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def _save(self, rows: DataFrame) -> tuple[int, str]:
        name = f"suffixes_{uuid.uuid4().hex}"
        # Dealt by gram already, by an aggregate or a merge: where tasks and buckets are as many, a task holds whole buckets.
        rows = rows if self.buckets == shuffle_parts(self.spark) else rows.repartition(self.buckets, "gram")
        rows.select("gram", "n", "ctx", "doc_id", "at").write.option("path", f"{self.path}/{name}").option("compression", "zstd").bucketBy(self.buckets, "gram").sortBy("gram").saveAsTable(name)
        return self.spark.table(name).count(), name

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame, how: str = "full") -> DataFrame:
        """Merge-scan of two arrays by their order: entries of either (or of b, how="right"), and for those of both whether the contexts agree."""
        b = b.withColumnsRenamed({c: f"{c}_" for c in ("n", "ctx", "doc_id", "at")})
        both = F.col("n").isNotNull() & F.col("n_").isNotNull()
        ctx = F.when(~both, F.coalesce("ctx", "ctx_")).when(F.col("ctx") == F.col("ctx_"), F.col("ctx"))
        joined = a.hint("merge").join(b.hint("merge"), "gram", how)
        place = [F.when(F.col("n").isNotNull(), F.col(c)).otherwise(F.col(f"{c}_")).alias(c) for c in ("doc_id", "at")]
        return joined.select("gram", (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n"), ctx.alias("ctx"), *place)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: anchor rows.  The entries of the batch's array that occur more than once, in it or in the levels before it, with the counts and contexts of both; then the array joins the family."""
        one = batch.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("a"), F.max("ctx").alias("b"), F.min(F.struct("doc_id", "at")).alias("first"))
        level = self._save(one.select("gram", "n", F.when(F.col("a") == F.col("b"), F.col("a")).alias("ctx"), "first.*"))
        found = self.spark.table(level[1])
        for _, name in self.levels:
            found = self._merged(self.spark.table(name), found, "right")
        found = stored(found.where("n > 1"), f"{self.path}/matches_{self.turn}")
        gone = []
        while self.levels and self.levels[-1][0] < RATIO * level[0]:
            gone += [self.levels.pop()[1], level[1]]
            level = self._save(self._merged(self.spark.table(gone[-2]), self.spark.table(gone[-1])))
        self.levels.append(level)
        self.turn += 1
        rows = [(self.turn, self.buckets, self.levels)]
        self.spark.createDataFrame(rows, "turn long, buckets int, levels array<struct<rows:long,name:string>>").coalesce(1).write.json(f"{self.path}/manifest/{self.turn:08d}")
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.spark.createDataFrame([], ENTRY).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return found

    def close(self) -> None:
        """Takes the tables out of the session's catalog; their files stay."""
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _runs(found: np.ndarray) -> tuple[list[int], list[int]]:
    """Byte ranges that windows at the sorted places ``found`` cover, joined where they touch."""
    cut = np.flatnonzero(np.diff(found) > LENGTH)
    return found[np.append(0, cut + 1)].tolist(), (found[np.append(cut, len(found) - 1)] + LENGTH).tolist()


_RANGES = pa.schema([("g", pa.binary()), ("ctx", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("n", pa.int64())])
RANGES = "g binary, ctx long, starts array<int>, ends array<int>, n long"


def window_hashes(context: bytes) -> np.ndarray:
    h = prefix_hash(np.frombuffer(context, np.uint8))
    start = np.arange(len(context) - LENGTH + 1)
    return hash_between(h, start, start + LENGTH)


def _second_hashes(context: bytes) -> np.ndarray:
    """Hashes of the windows by another base."""
    p = powers(_OTHER_BASE, len(context) + 1)
    h = np.zeros(len(context) + 1, np.uint64)
    np.cumsum(_VALUE[255 - np.frombuffer(context, np.uint8)] * p[:-1], out=h[1:])
    start = np.arange(len(context) - LENGTH + 1)
    return mix((h[start + LENGTH] - h[start]) * powers(pow(_OTHER_BASE, -1, 2**64), len(context) + 1)[start])


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the windows at a are those at b.  Where both go on by one from the pair before, only their last bytes are new."""
    on = np.zeros(len(a), bool)
    on[1:] = (np.diff(a) == 1) & (np.diff(b) == 1)
    if (data[a[on] + LENGTH - 1] != data[b[on] + LENGTH - 1]).any():
        return False
    first = np.flatnonzero(~on)
    return all(
        bool((data[a[part][:, None] + np.arange(LENGTH)] == data[b[part][:, None] + np.arange(LENGTH)]).all()) for part in (first[k : k + 5_000] for k in range(0, len(first), 5_000))
    )


def _compare(rows: list[dict]) -> list[dict]:
    """Contexts of one string; for each the ranges, from the anchor, of windows that occur twice."""
    hashes = [window_hashes(r["context"]) for r in rows]
    sizes = np.array([len(x) for x in hashes])
    _, where, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    # The place of each window in all contexts one after the other, and of the first with its hash.
    data = np.frombuffer(b"".join(r["context"] for r in rows), np.uint8)
    ends = np.cumsum([len(r["context"]) for r in rows])
    place = np.concatenate([np.arange(n) + e - len(r["context"]) for r, n, e in zip(rows, sizes, ends, strict=True)])
    if not _same_bytes(data, place, place[where][which]):  # two windows share a hash only: go by the bytes alone
        raw = data.tobytes()
        _, which = np.unique([raw[p : p + LENGTH] for p in place.tolist()], return_inverse=True)
    times = np.bincount(which, weights=np.repeat([r["n"] for r in rows], sizes))[which]
    out, at = [], 0
    for r, n in zip(rows, sizes.tolist(), strict=True):
        found = np.flatnonzero(times[at : at + n] > 1) - r["left"]
        at += n
        if len(found):
            starts, ends_ = _runs(found)
            out.append({"g": r["g"], "ctx": r["ctx"], "starts": starts, "ends": ends_, "n": r["n"]})
    return out


def _by_string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    out: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["g"] != row["g"]:
                out += _compare(held)
                held = []
            held.append(row)
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, schema=_RANGES)
                out = []
    if held:
        out += _compare(held)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_RANGES)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            f, f2 = window_hashes(r["context"]).view(np.int64), _second_hashes(r["context"]).view(np.int64)
            k = len(f)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(f2), pa.array([r["g"]] * k, pa.binary()), pa.array([r["ctx"]] * k, pa.int64()), pa.array(np.arange(k, dtype=np.int32) - r["left"]), pa.array([r["n"]] * k, pa.int64())], ["f", "f2", "g", "ctx", "r", "n"])


def _to_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            starts, ends = _runs(np.sort(np.array(r["r"])))
            out.append({"g": r["g"], "ctx": r["ctx"], "starts": starts, "ends": ends, "n": r["n"]})
        yield pa.RecordBatch.from_pylist(out, schema=_RANGES)


def _same(id_: str = "id_", tk: str = "tk_") -> Column:
    return F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("tk").eqNullSafe(F.col(tk))


def _texts_of(docs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Texts of the documents in ``rows`` (id_, tk_, value), with the value.  The ids first filter the documents by broadcast where they are few enough."""
    ids = rows.select("id_", "tk_")
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), _same(), "left_semi")
    return docs.join(rows.hint("merge"), _same()).select("doc_id", "tk", "text", value)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("g", pa.binary()), ("ctx", pa.int64()), ("left", pa.int32()), ("n", pa.int64()), ("context", pa.binary())])
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            out = []
            for r in batch.slice(lo, 100).to_pylist():
                text = r["text"].encode()
                out += [{"g": x["g"], "ctx": x["ctx"], "left": x["at"] - x["lo"], "n": x["n"], "context": text[x["lo"] : x["hi"] + LENGTH]} for x in r["xs"]]
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _split(rows: DataFrame, table: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """rows joined with table (keys, n and more): its rows of n over ``limit`` by broadcast, since there are few of them, the others by a merge."""
    hot, cold = F.broadcast(table.where(F.col("n") > limit)), table.where(F.col("n") <= limit)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold.hint("merge"), keys)
    return rows.join(hot, keys).unionByName(rest).drop("n")


def repeated_ranges(docs: DataFrame, scratch: str, batches: int = BATCHES) -> DataFrame:
    """id_, tk_ and ranges (array of start, end; may overlap) of each document that holds a repeated string."""
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id", "tk"), F.lit(batches)).cast("int").alias("batch")
    anchor_rows(docs).select("*", batch).write.partitionBy("batch").option("compression", "zstd").parquet(f"{scratch}/anchors")
    rows = spark.read.schema(ANCHOR + ", batch int").parquet(f"{scratch}/anchors")
    family, found = IndexFamily(spark, f"{scratch}/family"), None
    for k in range(batches):
        matches = family.add(rows.where(F.col("batch") == k).drop("batch"))
        found = matches if found is None else found.unionByName(matches)
    family.close()
    # A string met in several batches is known best from the last, which has seen most of it.
    again = found.groupBy("gram").agg(F.max(F.struct("n", F.col("ctx").isNull().alias("mixed"))).alias("x")).select("gram", "x.n", "x.mixed")
    limit = rows.count() // HOT_STRINGS + 1
    met = stored(_split(rows.drop("batch"), stored(again, f"{scratch}/again"), ["gram"], limit).withColumnRenamed("gram", "g"), f"{scratch}/met")
    whole = met.where(~F.col("mixed")).select(F.col("doc_id").alias("id_"), F.col("tk").alias("tk_"), F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    mixed = met.where("mixed")
    one = F.min(F.struct("doc_id", "tk", "at", "lo", "hi")).alias("one")
    kinds = stored(mixed.groupBy("g", "ctx").agg(F.count(F.lit(1)).alias("n"), one), f"{scratch}/kinds")
    many = stored(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > CONTEXTS).select(F.col("g").alias("g_")), f"{scratch}/many")
    per_doc = kinds.groupBy(F.col("one.doc_id").alias("id_"), F.col("one.tk").alias("tk_")).agg(
        F.collect_list(F.struct("g", "ctx", F.col("one.at").alias("at"), F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), "n")).alias("xs")
    )
    per_doc = stored(per_doc, f"{scratch}/per_doc")
    contexts = stored(_texts_of(docs, per_doc, "xs").mapInArrow(_contexts, "g binary, ctx long, left int, n long, context binary"), f"{scratch}/contexts")
    # ``many`` has a row for each string with over CONTEXTS contexts: no more than one anchor in CONTEXTS.
    few = many.count() <= BROADCAST_IDS
    hot = F.broadcast(many) if few else many
    ranges = contexts.join(hot, F.col("g") == F.col("g_"), "left_anti").repartition("g").sortWithinPartitions("g").mapInArrow(_by_string, RANGES)
    if not many.isEmpty():
        windows = contexts.join(hot, F.col("g") == F.col("g_"), "left_semi").mapInArrow(_windows, "f long, f2 long, g binary, ctx long, r int, n long")
        windows = stored(windows, f"{scratch}/windows")
        twice = stored(windows.groupBy("f", "f2").agg(F.sum("n").alias("times")).where("times > 1").select("f", "f2"), f"{scratch}/twice")
        seen = windows.join(twice.hint("merge"), ["f", "f2"]).groupBy("g", "ctx").agg(F.collect_set("r").alias("r"), F.max("n").alias("n"))
        ranges = ranges.unionByName(seen.mapInArrow(_to_ranges, RANGES))
    ranges = stored(ranges, f"{scratch}/ranges")
    parts = _split(mixed, ranges, ["g", "ctx"], limit)
    parts = parts.select(F.col("doc_id").alias("id_"), F.col("tk").alias("tk_"), "at", F.explode(F.arrays_zip("starts", "ends")).alias("x"))
    parts = parts.select("id_", "tk_", (F.col("at") + F.col("x.starts")).alias("start"), (F.col("at") + F.col("x.ends")).alias("end"))
    return whole.unionByName(parts).groupBy("id_", "tk_").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            raw, spans = text.encode(), merge([(r["start"], r["end"]) for r in ranges])
            ends = [0, *[b for _, b in spans]]
            kept = b"".join(raw[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(raw)], strict=True))
            for column, value in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, scratch: str | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A null text is empty.  All occurrences of a repeated string go, the first
    included.  Rows that repeat an id and a text are occurrences like any other."""
    scratch = scratch or work_dir(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(repeated_ranges(own, scratch, batches), f"{scratch}/found")
    cut = _texts_of(own, found, "ranges").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    ids = found.select("id_", "tk_")
    rest = own.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, _same(), "left_anti")
    zero = F.lit(0).cast("long")
    rest = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(rest)
