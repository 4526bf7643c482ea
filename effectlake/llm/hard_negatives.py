"""Hard negatives by rotated one-bit codes.

Vectors are rotated at random (signs and a Hadamard transform).  The signs of the
rotated components are a vector's code, the corner c of a cube of unit diagonal; with
it are stored its alignment <v, c> and its residual, the length of v - <v, c> c.  An
anchor a is cut into bit planes, so that popcounts of code and plane give <a, c> but
for a known error.  Then <a, v> = <v, c> <a, c> + <a', v'>, a' and v' being what is
left of each beside c, and by Cauchy-Schwarz the last term is at most the product of
their lengths.  Only where this interval may reach what an anchor still lacks is the
integer product taken.

Anchors are cut into blocks, rows into parts; a task has the cell of one block and
one part, and keeps for each anchor the best found so far.  An anchor's finds in all
cells are ranked at last, a fixed number of rows per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_parts, stored, work_dir

#: Bit planes of an anchor's rotated components.
PLANES = 6
#: Anchors of a block, and rows of a part, at most about.
BLOCK, PART = 4096, 1 << 16
#: Numbers of a block's vectors, at most about.
BLOCK_NUMBERS = 1 << 22
#: Tasks of a grid, where it isn't the session that asks for more.
TASKS = 50_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
CODES = "vec_id long, label long, vector array<long>, code binary, align double, residual double, size double"


def rotated(v: np.ndarray) -> np.ndarray:
    """Rows of v, padded to a power of two with zeros, under a fixed random rotation."""
    n, dims = len(v), 1 << max(v.shape[1] - 1, 0).bit_length()
    x = np.zeros((n, dims))
    x[:, : v.shape[1]] = v * np.random.default_rng(13).choice([-1.0, 1.0], max(v.shape[1], 1))[: v.shape[1]]
    half = 1
    while half < dims:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, dims)
        half *= 2
    return x / np.sqrt(dims)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    n, dims = bits.shape
    words = np.zeros((n, -(-dims // 64) * 8), np.uint8)
    own = np.packbits(bits, axis=1, bitorder="little")
    words[:, : own.shape[1]] = own
    return words.view("<u8")


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows of a matrix; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _coder(dims: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix_of(batch.column("vector"), dims).astype(float)
            x = rotated(v)
            align, size = np.abs(x).sum(1) / np.sqrt(x.shape[1]), (x**2).sum(1)
            code = packed(x >= 0)
            columns = [*[batch.column(c) for c in ("vec_id", "label", "vector")], pa.array([r.tobytes() for r in code], pa.binary()), *map(pa.array, (align, np.sqrt(np.maximum(size - align**2, 0)), np.sqrt(size)))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector", "code", "align", "residual", "size"])

    return run


class Anchor:
    """One anchor's planes, and the interval of its products with coded rows."""

    def __init__(self, vector: np.ndarray, x: np.ndarray):
        dims = len(x)
        low, step = float(x.min()), float(np.ptp(x)) / ((1 << PLANES) - 1)
        q = np.rint((x - low) / step).astype(np.int64) if step > 0 else np.zeros(dims, np.int64)
        self.planes = [packed((q >> k & 1).astype(bool)[None])[0] for k in range(PLANES)]
        self.low, self.step, self.root, self.vector = low, step, np.sqrt(dims), vector
        self.total, self.error = float((low + step * q).sum()), float(np.abs(x - low - step * q).sum()) / np.sqrt(dims)
        self.size = float(np.sqrt((x**2).sum()))

    def bounds(self, code: np.ndarray, ones: np.ndarray, align: np.ndarray, residual: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = sum((np.bitwise_count(code & plane).sum(1, dtype=np.int64) << k for k, plane in enumerate(self.planes)), np.zeros(len(code), np.int64))
        along = (2 * (self.low * ones + self.step * shared) - self.total) / self.root
        beside = np.sqrt(np.maximum(self.size**2 - np.maximum(np.abs(along) - self.error, 0) ** 2, 0))
        slack = align * self.error + beside * residual + 1e-6 * self.size * size + 1e-3  # the last two for rounding
        return along * align - slack, along * align + slack


class Rows:
    """A batch of coded rows, by label."""

    def __init__(self, batch: pa.RecordBatch, dims: int):
        label = batch.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        batch = batch.take(pa.array(order))
        self.label, self.ids = label[order], batch.column("vec_id").to_numpy()
        self.vectors = matrix_of(batch.column("vector"), dims)
        self.code = np.frombuffer(b"".join(batch.column("code").to_pylist()), "<u8").reshape(len(order), -1)
        self.ones = np.bitwise_count(self.code).sum(1, dtype=np.int64)
        self.align, self.residual, self.size = (batch.column(c).to_numpy() for c in ("align", "residual", "size"))
        self.most = int(np.abs(self.vectors.astype(float)).max(initial=0))
        self.floats = self.vectors.astype(float) if self.most < 1 << 53 else None

    def scores(self, which: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Integer products, in floats or 64 bits where these hold them without a digit lost; else in Python's numbers, held to the range of a long."""
        bound = float(self.most) * float(np.abs(a.astype(float)).max(initial=0)) * max(len(a), 1)
        if bound < 1 << 53 and self.floats is not None:
            return (self.floats[which] @ a.astype(float)).astype(np.int64)
        if bound < 1 << 62:
            return self.vectors[which] @ a
        exact = self.vectors[which].astype(object) @ a.astype(object)
        return np.array([min(max(int(s), _LEAST), _MOST) for s in exact], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = np.concatenate([scores, more]), np.concatenate([ids, more_ids])
    first = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == _LEAST else -scores))[:k]
    return scores[first], ids[first]


class Positives:
    """The best rows of an anchor's own label."""

    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def __init__(self, row: dict, anchor: Anchor, k: int):
        self.id, self.label, self.anchor, self.k = row["vec_id"], row["label"], anchor, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, rows: Rows) -> None:
        own = slice(*np.searchsorted(rows.label, [self.label, self.label + 1]))
        if own.start == own.stop:
            return
        _, high = self.anchor.bounds(rows.code[own], rows.ones[own], rows.align[own], rows.residual[own], rows.size[own])
        left = rows.ids[own] != self.id
        if len(self.scores) == self.k:
            left &= high >= self.scores[-1]
        which = own.start + np.flatnonzero(left)
        self.scores, self.ids = _best(self.scores, self.ids, rows.scores(which, self.anchor.vector), rows.ids[which], self.k)

    def found(self) -> list[tuple]:
        return [(self.id, i, s) for i, s in zip(self.ids.tolist(), self.scores.tolist(), strict=True)]


class Negatives:
    """For each positive of an anchor, the best rows of other labels whose score is within its window."""

    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def __init__(self, row: dict, anchor: Anchor, k: int, low: int, high: int):
        self.id, self.label, self.anchor, self.k, self.positives = row["vec_id"], row["label"], anchor, k, row["positives"]
        ends = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in self.positives]
        self.ends = [(max(a, _LEAST), min(b, _MOST)) for a, b in ends]
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ends]

    def meet(self, rows: Rows) -> None:
        low, high = self.anchor.bounds(rows.code, rows.ones, rows.align, rows.residual, rows.size)
        least = [max(a, int(s[-1])) if len(s) == self.k else a for (a, _), (s, _) in zip(self.ends, self.best, strict=True)]
        open_ = [(a, b) for a, (_, b) in zip(least, self.ends, strict=True) if a <= b]
        near = np.zeros(len(rows.ids), bool)
        for a, b in open_:
            near |= (high >= a) & (low <= b)
        which = np.flatnonzero(near & (rows.label != self.label))
        if not len(which):
            return
        scores, ids = rows.scores(which, self.anchor.vector), rows.ids[which]
        for k, (a, (_, b)) in enumerate(zip(least, self.ends, strict=True)):
            inside = (scores >= a) & (scores <= b)
            if inside.any():
                self.best[k] = _best(*self.best[k], scores[inside], ids[inside], self.k)

    def found(self) -> list[tuple]:
        return [(self.id, p["positive_id"], p["positive_score"], i, s) for p, (scores, ids) in zip(self.positives, self.best, strict=True) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]


def _cells(dims: int, kind: Callable, *args: int):  # noqa: ANN202
    """Runs over rows sorted by cell, a cell's anchors before its rows; ``kind`` is what an anchor looks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors = None, []

        def done() -> pa.RecordBatch:
            found = [x for a in anchors for x in a.found()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(kind.schema), schema=kind.schema)

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "part", "is_row")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                piece, cell = batch.slice(a, b - a), (keys[0, a], keys[1, a])
                if cell != now:
                    if anchors:
                        yield done()
                    now, anchors = cell, []
                if keys[2, a]:
                    rows = Rows(piece, dims) if anchors else None
                    for anchor in anchors:
                        anchor.meet(rows)
                else:
                    vectors = matrix_of(piece.column("vector"), dims)
                    columns = [c for c in ("vec_id", "label", "positives") if c in piece.schema.names]
                    for r, v, x in zip(piece.select(columns).to_pylist(), vectors, rotated(vectors.astype(float)), strict=True):
                        anchors.append(kind(r, Anchor(v, x), *args))
        if anchors:
            yield done()

    return run


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, dims: int, run: Callable, shape: str) -> DataFrame:
    """``run`` over all cells of blocks of anchors and parts of rows."""
    wanted = shuffle_parts(rows.sparkSession)
    blocks = -(-n_anchors // max(1, min(BLOCK, BLOCK_NUMBERS // max(dims, 1))))
    parts = max(-(-n_rows // PART), -(-wanted // max(blocks, 1)), 1)
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("*", place(max(blocks, 1), 1).alias("block"), each(parts).alias("part"), F.lit(0).alias("is_row"))
    right = rows.select("*", each(max(blocks, 1)).alias("block"), place(parts, 2).alias("part"), F.lit(1).alias("is_row"))
    dealt = left.unionByName(right, allowMissingColumns=True).repartition(max(wanted, min(blocks * parts, TASKS)), "block", "part").sortWithinPartitions("block", "part", "is_row")
    return dealt.mapInArrow(run, shape)


def code_vectors(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Writes the codes of ``rows`` (vec_id, label, vector of longs) and returns them with the number of components."""
    bounded_batches(rows.sparkSession)
    own = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    own = own.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))).alias("r")).select("vec_id", "r.*")
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    dims = max(dims or 0, 0)
    return stored(own.mapInArrow(_coder(dims), CODES), path), dims


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scratch: str | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and vector (integers).  For each row for which
    ``is_anchor`` holds, its first ``positives`` other rows of its label by integer
    inner product, ties by the smaller vec_id; for each of these the first
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of
    the positive's.

    Rows with a null vec_id, label, vector or component take no part.  Rows that share a
    vec_id count once, that of the least label, then vector.  Shorter vectors end in
    zeros.  Scores beyond the range of a long are held to it.  An anchor without
    positives, and a positive without negatives, have no row; other columns are not
    read; no rows give none."""
    scratch = scratch or work_dir(rows.sparkSession)
    codes, dims = code_vectors(rows.select("vec_id", "label", "vector"), f"{scratch}/codes")
    n_rows, n_anchors = codes.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    anchors = codes.where(is_anchor).select("vec_id", "label", "vector")
    best = lambda found, keys, score, other, k: found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), other))).where(F.col("rank") <= k)
    near = _grid(anchors, codes, n_anchors, n_rows, dims, _cells(dims, Positives, positives), "anchor_id long, positive_id long, positive_score long")
    kept = best(near, ["anchor_id"], "positive_score", "positive_id", positives)
    lists = stored(kept.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives")), f"{scratch}/positives")
    wanted = anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    shape = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = _grid(wanted, codes, n_anchors, n_rows, dims, _cells(dims, Negatives, negatives, low, high), shape)
    out = best(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
