"""WARC archives: writing with segmentation and revisits, and reassembly when reading.

Writing.  A page becomes an HTTP response whose body is sent in chunks.  A block
longer than ``segment`` bytes is cut: the first record has segment number 1 and
each ``continuation`` record names it in WARC-Segment-Origin-ID; the last one
states WARC-Segment-Total-Length.  Of pages with the same payload the one with
the smallest id is a response and the others are revisits of it.  Only ids and
digests are shuffled to find that out.  Records are rows of binary, and Spark's
text writer, with the blank lines that end a WARC record as line separator,
commits them as gzip files to any store it reaches (it names them .txt.gz).  A
file holds at most ``FILE_RECORDS`` records of at most ``SEGMENT`` bytes each and
their headers, so a reader's task is bounded whatever the pages.

Reading.  Each file is parsed record by record by Content-Length.  Segments are
grouped by the id of their first record, a row each, ordered by segment number,
checked against the total length, joined, and freed of the chunked framing.  The
group of an origin is one page, so it is as large as one page can be.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, work_dir

END = "\r\n\r\n"
SEGMENT, HTTP_CHUNK = 32 << 10, 4 << 10
#: Groups of equal payloads with more than this share of all pages are joined by broadcast.
HOT_GROUPS = 4096
#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: how a gzip file starts.
GZIP = b"\x1f\x8b"
#: Records of a file at most.
FILE_RECORDS = 8_192
#: More bytes of notes on revisits than this aren't broadcast; a note is 24 bytes.
BROADCAST_BYTES = 32 << 20


def base32_of_hex(hex40: Column) -> Column:
    """A SHA-1 in hex as base32: four times ten hex digits are eight letters each."""
    out = []
    for k in range(4):
        n = F.conv(F.substring(hex40, 10 * k + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), (F.shiftright(n, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*out)


def revisits(pages: DataFrame, scratch: str, least_bytes: int = 0) -> DataFrame:
    """page_id, html_key (a hash), first: pages with the payload of another page, and that page, the one of the smallest id.

    A null id comes after all others; pages of null ids alone are no revisits.  A
    payload of over 1/HOT_GROUPS of all pages meets its pages by broadcast: there are
    no more than HOT_GROUPS of those."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keys = stored(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64(html).alias("html_key"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"), F.octet_length(html).alias("n_bytes")),
        f"{scratch}/payloads",
    )
    groups = stored(
        keys.where(F.col("n_bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL"),
        f"{scratch}/groups",
    )
    limit = keys.count() // HOT_GROUPS + 1
    hot, cold = F.broadcast(groups.where(F.col("n") > limit)), groups.where(F.col("n") <= limit)
    few = keys.join(hot, "sha1")
    rest = keys.join(hot.select("sha1"), "sha1", "left_anti").join(cold.hint("merge"), "sha1")
    again = few.unionByName(rest).where(~F.col("page_id").eqNullSafe(F.col("first")))
    return stored(again.select("page_id", "html_key", "first").distinct(), f"{scratch}/revisits")


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := body[i : i + size]), p) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(framed: bytes) -> bytes:
    """The payload of a chunked body; an error if the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(framed[end + 2 : end + 2 + n])
        if framed[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + n


def records_of(page: dict, segment: int = SEGMENT, chunk: int = HTTP_CHUNK) -> Iterator[bytes]:
    """The WARC records of a page, without the two line ends that close each."""
    payload = (page["html"] or "").encode()
    digest, revisit = digest_of(payload), page["refers_to"] is not None
    me = record_id(page["page_id"], digest)
    common = [f"WARC-Date: {DATE}", f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', page['url'] or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    own = [] if page["page_id"] is None else [f"X-Page-ID: {page['page_id']}"]
    if revisit:
        kind = ["WARC-Type: revisit", f"WARC-Refers-To: <{record_id(page['refers_to'], digest)}>", f"X-Refers-To-Page: {page['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = HTTP_HEAD
    else:
        kind, block = ["WARC-Type: response"], HTTP_HEAD + chunked(payload, chunk)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, piece in enumerate(pieces, 1):
        head = ["WARC/1.1"]
        if k == 1:
            head += [*kind, f"WARC-Record-ID: <{me}>", *own, *common]
        else:
            head += ["WARC-Type: continuation", f"WARC-Record-ID: <{me}-{k}>", f"WARC-Segment-Origin-ID: <{me}>", common[0], common[1]]
        if len(pieces) > 1:
            head.append(f"WARC-Segment-Number: {k}")
            if k == len(pieces) > 1:
                head.append(f"WARC-Segment-Total-Length: {len(block)}")
        yield "\r\n".join([*head, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(piece)}", "", ""]).encode() + piece


def write(pages: DataFrame, path: str, scratch: str, least_bytes: int = 0) -> None:
    """A record for each row of pages (page_id, url, html), in segments if it is long.

    A null html is an empty payload, a null url an empty one.  Rows that repeat an
    id and its html are written each, under one record id."""
    again = revisits(pages, scratch, least_bytes).withColumnsRenamed({"page_id": "id_", "html_key": "key_", "first": "refers_to"})
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("key"))
    few = again.count() * 24 <= BROADCAST_BYTES
    both = own.join(F.broadcast(again) if few else again, F.col("page_id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = [r for page in batch.slice(lo, 256).to_pylist() for r in records_of(page)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    records = both.select("page_id", "url", "html", "refers_to").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


RECORD = "origin string, segment int, total long, kind string, page_id long, refers_to long, digest string, block binary"


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        block = data[cut + 4 : cut + 4 + n]
        if len(block) < n or data[cut + 4 + n : cut + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        at = cut + 8 + n
        yield {
            "origin": head.get("warc-segment-origin-id") or head["warc-record-id"], "segment": int(head.get("warc-segment-number", 1)),
            "total": int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else n if "warc-segment-number" not in head else None,
            "kind": head["warc-type"], "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
            "refers_to": int(head["x-refers-to-page"]) if "x-refers-to-page" in head else None,
            "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "block": block,
        }


_SCHEMA = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
_PAGE = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("payload", pa.binary())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held: list[dict] = []
                data = batch.column("content")[k].as_py()
                for r in parse(gzip.decompress(data) if data[:2] == GZIP else data):
                    held.append(r)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    return files.mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, stated_digest, payload (null for a revisit): segments joined, lengths verified, framing decoded.

    A record whose segments are missing or don't add up is an error, never a row.
    A record that is there several times, each segment as often, is as many rows;
    its copies are counted before they are shuffled."""
    whole = records.where(F.col("total").isNotNull() & (F.col("segment") == 1)).select("page_id", "kind", "refers_to", "digest", "block")
    cut = records.where(F.col("total").isNull() | (F.col("segment") > 1))
    once = cut.groupBy("origin", "segment").agg(*[F.first(c).alias(c) for c in ("kind", "page_id", "refers_to", "digest", "block", "total")], F.count(F.lit(1)).alias("times"))
    heads = F.min_by(F.struct("kind", "page_id", "refers_to", "digest"), "segment")
    parts = once.groupBy("origin").agg(
        heads.alias("h"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), F.min("times").alias("times"), F.max("times").alias("most")
    )
    joined = F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), "")
    parts = parts.select("h.*", F.unhex(joined).alias("block"), "total", "times", "most", F.size("parts").alias("n"), F.element_at("parts", -1)["segment"].alias("last"))
    sound = (F.octet_length("block") == F.col("total")) & (F.col("n") == F.col("last")) & (F.col("times") == F.col("most"))
    parts = parts.withColumn("block", F.when(sound, F.col("block")).otherwise(F.raise_error(F.lit("segments are missing or don't add up"))))
    parts = parts.select("page_id", "kind", "refers_to", "digest", "block", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                head, _, body = r["block"].partition(b"\r\n\r\n")
                if r["kind"] == "revisit":
                    payload = None
                else:
                    payload = dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body
                out.append({"page_id": r["page_id"], "record_type": r["kind"], "refers_to": r["refers_to"], "stated_digest": r["digest"], "payload": payload})
            yield pa.RecordBatch.from_pylist(out, schema=_PAGE)

    return whole.unionByName(parts).mapInArrow(run, "page_id long, record_type string, refers_to long, stated_digest string, payload binary")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archive_and_read(pages: DataFrame, least_bytes: int = 0, scratch: str | None = None) -> DataFrame:
    """Writes the archives, reads them back, and returns page_id, payload_bytes, payload_digest, record_type, refers_to: a row for each row of ``pages``.

    The length and digest of a revisit are those of the response that it names,
    as read back; that response is found by a join whose other side has one row
    per group of equal payloads, and a response that is missing is an error.  A page of null id is a revisit where another
    page of the same payload has an id, else a response."""
    spark = pages.sparkSession
    scratch = scratch or work_dir(spark)
    write(pages, f"{scratch}/warc", scratch, least_bytes)
    return resolved(reassemble(read_records(spark, f"{scratch}/warc")), scratch)


def resolved(found: DataFrame, scratch: str) -> DataFrame:
    """A row per reassembled record, revisits with the length and digest of the response that they name; a response that is missing, or differs from its digest, is an error."""
    hexed = found.select("page_id", "record_type", "refers_to", "stated_digest", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("h"))
    short = stored(hexed, f"{scratch}/read").select("page_id", "record_type", "refers_to", "stated_digest", "n", F.when(F.col("h").isNotNull(), base32_of_hex(F.col("h"))).alias("d"))
    own = short.where("record_type = 'response'").select(
        "page_id", F.col("n").alias("payload_bytes"),
        F.when(F.col("d") == F.col("stated_digest"), F.col("d")).otherwise(F.raise_error(F.lit("the payload differs from its digest"))).alias("payload_digest"),
        "record_type", "refers_to",
    )
    again = short.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated_digest")
    named = again.groupBy("refers_to", "stated_digest").agg(F.count(F.lit(1)).alias("times"))
    responses = own.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"), "payload_bytes").distinct()
    missing = F.raise_error(F.lit("a revisit's response is missing")).cast("long")
    lengths = named.join(responses, ["refers_to", "stated_digest"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", missing))
    lengths = stored(lengths, f"{scratch}/named")
    limit = short.count() // HOT_GROUPS + 1
    hot, cold = F.broadcast(lengths.where(F.col("times") > limit)), lengths.where(F.col("times") <= limit)
    on = ["refers_to", "stated_digest"]
    rest = again.join(hot.select(*on), on, "left_anti").join(cold.hint("merge"), on)
    both = again.join(hot, on).unionByName(rest).select("page_id", "payload_bytes", F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to")
    return own.unionByName(both)
