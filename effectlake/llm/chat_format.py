"""Chats formatted into training text by columnar byte assembly.

A turn is written between the marks of its role; what of a text looks like a mark is
escaped, so the formatted text can be taken apart again.  A batch of turns is assembled
at once: its marks, roles and escaped texts lie in one pool of bytes, the lengths and
cumulative offsets of all segments give for each byte of the output its place in the
pool, and one gather fills the preallocated Arrow buffer.

Turns are dealt by ranges of (conv_id, turn), so that a conversation that holds a
large part of all rows is formatted by many tasks.  A row of the output is a
conversation, or a piece of one: a conversation is cut where it runs over the edge of
a range, and at turns where PIECE bytes have gone by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_parts, stored, work_dir

#: Opening and closing mark of a role; any other role is written out between OTHER's marks.
ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[:]", "[/ROLE]")
MARKS = [m.encode() for m in (*[m for pair in ROLES.values() for m in pair], *OTHER)]
#: The role whose texts are under the loss mask.
LEARNED = "assistant"
ESCAPE = 0x5C
#: Bytes of text after which a conversation is cut.
PIECE = 4 << 20
_KINDS = [*ROLES]
_FRAME = [b"".join((o.encode(), b" ")) for o, _ in ROLES.values()] + [OTHER[0].encode() + b" "]
_CLOSE = [b"".join((b" ", c.encode(), b"\n")) for _, c in ROLES.values()] + [b" " + OTHER[2].encode() + b"\n"]
_MIDDLE = b" " + OTHER[1].encode() + b" "
_TURN = re.compile(b"|".join([*[re.escape(o) + b"(.*?)" + re.escape(c) for o, c in zip(_FRAME[:-1], _CLOSE[:-1], strict=True)], re.escape(_FRAME[-1]) + b"(.*?)" + re.escape(_MIDDLE) + b"(.*?)" + re.escape(_CLOSE[-1])]), re.DOTALL)
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)

PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("text", pa.binary()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
PIECES_DDL = "conv_id long, part int, piece long, n_turns long, text binary, loss_starts array<long>, loss_ends array<long>"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings with a backslash before each backslash, and after the first byte of whatever looks like a mark."""
    points = [np.flatnonzero(data == ESCAPE)]
    for mark in MARKS:
        at = np.flatnonzero(data == mark[0])
        at = at[at + len(mark) <= len(data)]
        for k in range(1, len(mark)):
            at = at[data[at + k] == mark[k]]
        within = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(mark) - 1, "right")
        points.append(at[within] + 1)
    points = np.sort(np.concatenate(points))
    return np.insert(data, points, ESCAPE), offsets + np.searchsorted(points, offsets, "left")


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns as one buffer and their offsets in it, and where each turn's text begins and ends."""
    n = len(texts)
    kind = np.full(n, len(_KINDS))
    for k, role in enumerate(_KINDS):
        kind[pc.equal(roles, role).fill_null(False).to_numpy(zero_copy_only=False)] = k
    fixed = [*_FRAME, *_CLOSE, _MIDDLE, b""]
    fixed_sizes = np.array([len(x) for x in fixed])
    fixed_starts = np.cumsum(fixed_sizes) - fixed_sizes
    named, text = escaped(*_bytes_of(pc.if_else(pa.array(kind == len(_KINDS)), roles, pa.scalar("", pa.string())))), escaped(*_bytes_of(texts))
    base = int(fixed_sizes.sum())
    pool = np.concatenate([np.frombuffer(b"".join(fixed), np.uint8), named[0], text[0]])
    other, width = kind == len(_KINDS), len(_FRAME)
    marks = np.stack([kind, np.where(other, 2 * width, 2 * width + 1), kind + width])  # opening, middle, closing
    starts = np.stack([fixed_starts[marks[0]], base + named[1][:-1], fixed_starts[marks[1]], base + len(named[0]) + text[1][:-1], fixed_starts[marks[2]]], axis=1).ravel()
    sizes = np.stack([fixed_sizes[marks[0]], np.diff(named[1]), fixed_sizes[marks[1]], np.diff(text[1]), fixed_sizes[marks[2]]], axis=1).ravel()
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if n else 0
    out = np.empty(total, np.uint8)
    np.take(pool, np.repeat(starts - (ends - sizes), sizes) + np.arange(total), out=out)
    ends = ends.reshape(n, 5)
    return out, np.concatenate(([0], ends[:, -1])), ends[:, 2], ends[:, 3]


def _formatted(limit: int):  # noqa: ANN202
    def group(table: pa.Table, before: np.ndarray) -> pa.RecordBatch:
        """One row per run of equal (conversation, piece)."""
        table = table.combine_chunks()
        conv, piece = table.column("conv_id").combine_chunks(), before // limit
        ids, known = conv.fill_null(0).to_numpy(), conv.is_valid().to_numpy(zero_copy_only=False)
        out, offsets, lo, hi = assemble(table.column("role").combine_chunks(), table.column("text").combine_chunks())
        first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (known[1:] != known[:-1]) | (piece[1:] != piece[:-1]))))
        last = np.append(first[1:], len(ids))
        learned = pc.equal(table.column("role").combine_chunks(), LEARNED).fill_null(False).to_numpy(zero_copy_only=False)
        count = np.cumsum(np.append(0, learned))
        at = np.repeat(offsets[first], last - first)
        spans = pa.array(np.append(count[first], count[-1]), pa.int32())
        ends = np.append(offsets[first], offsets[-1])
        text = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
        columns = [
            conv.take(pa.array(first)), pa.array(np.full(len(first), TaskContext.get().partitionId()), pa.int32()), pa.array(piece[first]), pa.array(last - first), text,
            pa.ListArray.from_arrays(spans, pa.array((lo - at)[learned])), pa.ListArray.from_arrays(spans, pa.array((hi - at)[learned])),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_before, seen, open_conv = None, np.zeros(0, np.int64), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id")
            flat, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_binary())), 0).to_numpy().astype(np.int64)
            new = np.concatenate(([(known[0], flat[0]) != open_conv], (flat[1:] != flat[:-1]) | (known[1:] != known[:-1])))
            before = seen + np.cumsum(size) - size
            start = np.flatnonzero(new)
            before = before - np.repeat(np.append(0, before[start]), np.diff(np.concatenate(([0], start, [len(flat)]))))
            seen, open_conv = int(before[-1] + size[-1]), (known[-1], flat[-1])
            own = pa.Table.from_batches([batch])
            table, before, new = (own, before, new) if held is None else (pa.concat_tables([held, own]), np.append(held_before, before), np.append(np.zeros(held.num_rows, bool), new))
            edges = np.flatnonzero(new[1:] | (np.diff(before // limit) != 0)) + 1
            cut = int(edges[-1]) if len(edges) else 0
            if cut:
                yield group(table.slice(0, cut), before[:cut])
            held, held_before = table.slice(cut), before[cut:]
        if held is not None:
            yield group(held, held_before)

    return run


def format_chats(turns: DataFrame, path: str, piece_bytes: int = PIECE) -> DataFrame:
    """Writes one row per conversation - text (UTF-8) and the byte spans of its learned texts - or several, in order of (part, piece), where it is large or runs over the edge of a task's range.

    Rows go by turn, null first; those of equal turn by a hash of role and text, and
    repeated rows are turns of their own.  Null texts and roles are empty; null conv_ids
    are one conversation.  Other columns are not read; no rows give none."""
    bounded_batches(turns.sparkSession)
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    own = own.withColumn("tie", F.xxhash64("role", "text"))
    keys = ("conv_id", "turn", "tie")
    dealt = own.repartitionByRange(shuffle_parts(turns.sparkSession), *keys).sortWithinPartitions(*keys)
    return stored(dealt.select("conv_id", "role", "text").mapInArrow(_formatted(piece_bytes), PIECES_DDL), path)


def parse(text: bytes) -> list[tuple[bytes, bytes, int, int]]:
    """Role, text, and the text's byte span of each turn of a formatted piece."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        g, at = m.lastindex, m.end()
        role = _KINDS[g - 1].encode() if g <= len(_KINDS) else unescaped(m[g - 1])
        turns.append((role, unescaped(m[g]), m.start(g), m.end(g)))
    if at != len(text):
        raise ValueError(f"no turn at byte {at}")
    return turns


def unescaped(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", raw) if b"\\" in raw else raw


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, state, done = None, None, []
    for batch in batches:
        for r in batch.to_pylist():
            if state is None or r["conv_id"] != now:
                if state is not None:
                    done.append((now, *state))
                now, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = r["text"]
            for role, said, _, _ in parse(text):
                state[1].update(b"".join((role, b"\n", said, b"\n")))
                state[0] += 1
            for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True):
                said = unescaped(text[a:b])
                state[2] += len(said.decode())
                state[3].update(said)
            state[4] += len(text.decode())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (c, n, t.hexdigest(), k, h.hexdigest(), f), strict=True)) for c, n, t, k, h, f in done], schema=schema)
            done = []
    if state is not None:
        c, n, t, k, h, f = now, *state
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (c, n, t.hexdigest(), k, h.hexdigest(), f), strict=True))], schema=schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn), loss_chars and loss_sha256 (of what is under the mask), formatted_chars: all from the formatted text, taken apart again.

    A conversation's pieces are digested in order as they stream by, one at a time; the
    digest of a sequence leaves no other way."""
    dealt = pieces.repartition(shuffle_parts(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return dealt.select("conv_id", "text", "loss_starts", "loss_ends").mapInArrow(_digested, _DIGEST)


def format_and_read(turns: DataFrame, scratch: str | None = None) -> DataFrame:
    scratch = scratch or work_dir(turns.sparkSession)
    return read_back(format_chats(turns, f"{scratch}/chats"))
