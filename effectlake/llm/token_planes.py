"""Token ids in byte planes.

The ids of all documents, each followed by the end id, form one stream in
ascending order of documents.  Documents are range-partitioned by id, and each
partition cuts its part of the stream into chunks of ``CHUNK`` ids.  A chunk is
transposed: the first bytes of all ids, then the second bytes, and so on.  Each
byte plane is compressed with zstandard by itself; high planes are nearly
constant and shrink to next to nothing.

File format: a Parquet data set ``chunks`` of one row per chunk - part, chunk,
place, n_ids, planes (array of binary), and the documents that start in the chunk with
the place of their first id in the part, where the document of the chunk's first id
started, whether its last one runs on - and a data set ``index`` of one row per
chunk: part, chunk, first_id (in the whole stream), n_ids, n_docs, and the
compressed length of each plane.  Spark's own writer commits the files, so a
retried task leaves no second copy, and any store that Spark reaches will do.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, stored, work_dir
from .piece_ids import encoder_of
from .textbytes import slices

CHUNK = 1 << 16
END_ID = 2
#: Bytes of text in a write task, about.
PART_BYTES = 64 << 20
#: Stands for a null id within a task.
NO_ID = -(1 << 63)
CHUNK_SCHEMA = "part int, chunk int, place bigint, n_ids int, planes array<binary>, doc_ids array<bigint>, doc_starts array<bigint>, lead bigint, runs_on boolean, first_doc bigint, first_tie bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def to_planes(ids: np.ndarray, packer: zstandard.ZstdCompressor) -> list[bytes]:
    return [packer.compress(np.ascontiguousarray(p).tobytes()) for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor()
    return np.stack([np.frombuffer(raw.decompress(p, max_output_size=max(n, 1)), np.uint8) for p in planes], axis=1).reshape(-1).view("<u4") if n else np.zeros(0, "<u4")


def _writer(tokenizer: str, end_id: int, chunk_ids: int):  # noqa: ANN202
    kinds = [("part", pa.int32()), ("chunk", pa.int32()), ("place", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("lead", pa.int64()), ("runs_on", pa.bool_()), ("first_doc", pa.int64()), ("first_tie", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, schema = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3), pa.schema(kinds)
        waiting: list[np.ndarray] = []  # ids not yet written
        ids: list[np.ndarray] = []  # documents that start in them, and where
        starts: list[np.ndarray] = []
        held, place, k, first, lead = 0, 0, 0, None, None

        def flush(n: int) -> pa.RecordBatch:
            nonlocal waiting, held, k, ids, starts, lead
            stream, names, at = np.concatenate(waiting), np.concatenate(ids), np.concatenate(starts)
            waiting, held, high = [stream[n:]], len(stream) - n, k * chunk_ids + n
            mine = int(np.searchsorted(at, high))
            ends = at[mine] if mine < len(at) else place  # where the last document of the chunk ends
            row = {
                "part": part, "chunk": k, "place": k * chunk_ids, "n_ids": n, "planes": to_planes(stream[:n], packer), "doc_ids": [None if i == NO_ID else i for i in names[:mine].tolist()], "doc_starts": at[:mine],
                "lead": lead, "runs_on": bool(ends > high), "first_doc": first[0], "first_tie": first[1],
            }
            lead = int(at[mine - 1]) if mine else lead
            ids, starts, k = [names[mine:]], [at[mine:]], k + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            docs, encoder = batch.column("doc_id").fill_null(NO_ID).to_numpy(), encoder_of(tokenizer)
            if first is None and batch.num_rows:
                first = batch.column("doc_id")[0].as_py(), batch.column("tie")[0].as_py()
            for row, data, offsets in slices(batch.column("text")):
                sizes, coded = encoder.encode(data, offsets)
                ends = np.cumsum(sizes)
                waiting.append(np.insert(coded, ends, end_id))
                starts.append(place + np.arange(len(sizes)) + ends - sizes)
                ids.append(docs[row : row + len(sizes)])
                place, held = place + len(waiting[-1]), held + len(waiting[-1])
                while held >= chunk_ids:
                    yield flush(chunk_ids)
        if held:
            yield flush(held)

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, chunk_ids: int = CHUNK) -> None:
    """Writes ``chunks`` and ``index`` under ``path``.

    A null text is an empty one and has the end id alone.  Null ids come first.
    Rows of one doc_id follow in order of a hash of their texts; rows that repeat
    both are alike, so their order doesn't matter.  No rows: no chunks."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_parts(docs.sparkSession), -(-size // PART_BYTES))
    ordered = own.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.mapInArrow(_writer(tokenizer or default_tokenizer(), end_id, chunk_ids), CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = docs.sparkSession.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    bases = part_bases(chunks)
    rows = chunks.join(F.broadcast(bases), "part").select(
        "part", "chunk", (F.col("base") + F.col("place")).alias("first_id"), "n_ids", F.size("doc_ids").alias("n_docs"),
        F.transform("planes", F.octet_length).alias("plane_bytes"),
    )
    rows.write.parquet(f"{path}/index")


def part_bases(chunks: DataFrame) -> DataFrame:
    """part and the number of ids before it: one row per write task, few and small at any size of the corpus."""
    parts = chunks.groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n"), F.min(F.struct("first_doc", "first_tie")).alias("first"))
    before = Window.orderBy(F.col("first.first_doc").asc_nulls_first(), "first.first_tie").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


FRAGMENT = "part int, local long, chunk int, doc_id long, n long, crc long, whole boolean"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a chunk holds of each document, with its crc; a document within one chunk is whole."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            ids = from_planes(r["planes"], r["n_ids"])
            at = np.array(r["doc_starts"], np.int64) - r["place"]
            docs, starts = r["doc_ids"], list(r["doc_starts"])
            if not len(at) or at[0] > 0:
                at, docs, starts = np.append(0, at), [None, *docs], [r["lead"], *starts]
            ends = np.append(at[1:], len(ids))
            whole = np.ones(len(at), bool)
            whole[0] = starts[0] != r["lead"]
            whole[-1] &= not r["runs_on"]
            raw = ids.tobytes()
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array([r["chunk"]] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - at), pa.array(crcs, pa.int64()), pa.array(whole)],
                ["part", "local", "chunk", "doc_id", "n", "crc", "whole"],
            )


def _through(step: list[int], register: int) -> int:
    return functools.reduce(lambda s, k: s ^ (step[k] if register >> k & 1 else 0), range(32), 0)


@functools.cache
def _zero_bits(k: int) -> list[int]:
    """What 2**k zero bits make of each bit of a crc32's register."""
    if k == 0:
        return [0xEDB88320, *[1 << j for j in range(31)]]
    half = _zero_bits(k - 1)
    return [_through(half, v) for v in half]


def crc_of_both(a: int, b: int, n: int) -> int:
    """The crc32 of two strings in a row, from that of each and the length of the second: a goes through its zero bits."""
    bits = 8 * n
    for k in range(bits.bit_length()):
        if bits >> k & 1:
            a = _through(_zero_bits(k), a)
    return a ^ b


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for pieces in batch.column("pieces").to_pylist():
            crcs.append(functools.reduce(lambda s, p: crc_of_both(s, p["crc"], 4 * p["n"]), pieces, 0))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("part", "local", "doc_id", "n")], pa.array(crcs, pa.int64())], ["part", "local", "doc_id", "n", "crc"])


def read(spark: SparkSession, path: str, scratch: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the chunks.

    A task decodes the chunks that it reads where they lie; only the documents that
    run over the edge of a chunk, two pieces a chunk at most, are brought together."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    found = chunks.select("part", "chunk", "place", "n_ids", "planes", "doc_ids", "doc_starts", "lead", "runs_on")
    found = stored(found.mapInArrow(_fragments, FRAGMENT), f"{scratch}/fragments")
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "n", "crc"))).alias("pieces")
    cut = found.where("NOT whole").groupBy("part", "local").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"), pieces)
    cut = cut.mapInArrow(_joined, "part int, local long, doc_id long, n long, crc long")
    docs = found.where("whole").select("part", "local", "doc_id", "n", "crc").unionByName(cut)
    return docs.join(F.broadcast(part_bases(chunks)), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def encode_and_read(docs: DataFrame, tokenizer: str | None = None, scratch: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from the files that ``write`` makes of them.

    A null text is empty and has the end id alone; null ids come first, rows of one id in
    order of a hash of their texts; repeated rows each have their tokens and a row; no rows give none."""
    scratch = scratch or work_dir(docs.sparkSession)
    write(docs, f"{scratch}/tokens", tokenizer)
    return read(docs.sparkSession, f"{scratch}/tokens", scratch)
