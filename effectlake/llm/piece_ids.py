"""Token ids of whole texts, with a table of the ids of recurring pieces that is bounded in bytes.

A text is cut before each single space that stands between two other characters:
there byte-level BPE always starts a token anew.  Pieces recur, so the ids of a
piece are kept under a hash of its bytes, in sorted arrays: no Python object lives
on per piece.  Only pieces that the table lacks reach the tokenizer, cut once more
by its own pattern into the parts that it merges by itself, of which again only
the unknown ones are encoded.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from .textbytes import hash_between, mix, prefix_hash

#: Bytes of the table of pieces that a worker process keeps.
TABLE_BYTES = 16 << 20
#: Longer pieces are encoded each time: hashes of long strings are weaker, and long strings seldom recur.
LONGEST = 64
#: A byte-level tokenizer's sign for each byte; bytes without a sign of their own take those from U+0100 on.
BYTE_SIGN = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
BYTE_SIGN |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in BYTE_SIGN)}
#: Fixed value: the pattern of byte-level BPE for texts of ASCII and Latin letters, with NUL as a mark between pieces.
PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ\0]+|\s+(?![^\s\0])|\s+|\0", re.ASCII)

_BYTE = np.arange(256)
# White space, and the first bytes of the characters beyond ASCII that hold white space.
_NO_CUT = np.isin(_BYTE, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3])
_PLAIN = ((_BYTE >= 0x20) & (_BYTE < 0x7F)) | np.isin(_BYTE, [0x09, 0x0A, 0x0D])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of ``size`` places, one run after the other."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(total)


class Table:
    """Sorted keys with the ids of each, a run of one pool."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.sizes, self.pool = keys[order], sizes[order], ids
        self.starts = (np.cumsum(sizes) - sizes)[order]
        self.used = np.zeros(len(keys), bool)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at, np.zeros(len(keys), bool)
        at = np.minimum(at, len(self.keys) - 1)
        return at, self.keys[at] == keys

    def merged(self, other: Table, of_self: np.ndarray | slice = slice(None)) -> Table:
        keys, sizes, starts = self.keys[of_self], self.sizes[of_self], self.starts[of_self]
        return Table(
            np.concatenate((keys, other.keys)), np.concatenate((sizes, other.sizes)),
            np.concatenate((self.pool[spread(starts, sizes)], other.pool[spread(other.starts, other.sizes)])),
        )

    def nbytes(self) -> int:
        return 21 * len(self.keys) + 4 * len(self.pool)


def _empty() -> Table:
    return Table(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))


class Pieces:
    """Ids by key: a large table, and a small one of the latest.  When the large one is full, the pieces that were not asked for since the last time go."""

    def __init__(self, most_bytes: int = TABLE_BYTES):
        self.most, self.large, self.small = most_bytes, _empty(), _empty()

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is known, the number of its ids (0 if not), and all ids in order of the keys."""
        found = [(t, *t.find(keys)) for t in (self.large, self.small)]
        sizes = np.zeros(len(keys), np.int64)
        for t, at, ok in found:
            sizes[ok] = t.sizes[at[ok]]
            t.used[at[ok]] = True
        ids, place = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        for t, at, ok in found:
            ids[spread(place[ok], sizes[ok])] = t.pool[spread(t.starts[at[ok]], sizes[ok])]
        return found[0][2] | found[1][2], sizes, ids

    def put(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Keys that are not there yet, each once."""
        self.small = self.small.merged(Table(keys, sizes, ids))
        if len(self.small.keys) > max(20_000, len(self.large.keys) // 4):
            full = self.large.nbytes() + self.small.nbytes() > self.most
            kept = self.large.used if full else slice(None)
            self.large, self.small = self.large.merged(self.small, kept), _empty()
            if self.large.nbytes() > self.most:
                self.large = _empty()


class Encoder:
    """Whole texts, as UTF-8 bytes, to ids.  A tokenizer of another kind than byte-level BPE encodes each text whole."""

    def __init__(self, path: str, most_bytes: int = TABLE_BYTES):
        # Spark's tasks are the threads; those of the tokenizer would each keep memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.own = Tokenizer.from_file(path)
        self.pieces = Pieces(most_bytes)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        self.cuts = (
            kind["model"].get("type") == "BPE" and not kind.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and all(t["content"][:2] == "<|" and not t["lstrip"] and not t["rstrip"] for t in kind.get("added_tokens", []))
        )
        self.parts = Tokenizer(self.own.model)
        self.mark = BYTE_SIGN[0]
        self.parts.pre_tokenizer = pre_tokenizers.Split(self.mark, "isolated")
        self.mark_id = self.own.token_to_id(self.mark)
        self.cuts = self.cuts and self.mark_id is not None

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(c) for c in coded], np.int64), np.array([i for c in coded for i in c], np.uint32)

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of parts that are merged by themselves; a mark between them comes out as its own id."""
        signs = [self.mark.join(parts[k : k + 512]).encode().replace(self.mark.encode(), b"\0").decode("latin1").translate(BYTE_SIGN) for k in range(0, len(parts), 512)]
        ids = np.array([i for e in self.parts.encode_batch_fast(signs, add_special_tokens=False) for i in [*e.ids, self.mark_id]], np.uint32)
        ends = np.flatnonzero(ids == self.mark_id)
        return np.diff(ends, prepend=-1) - 1, ids[ids != self.mark_id]

    @staticmethod
    def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(hash_between(prefix_hash(data), start, end) + (end - start).astype(np.uint64))

    @staticmethod
    def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start: at each text that isn't empty, and at each single space between two other characters of it."""
        n = len(data)
        first = data if not (data >= 0x80).any() else data[np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(n), 0))]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        space = np.zeros(n, bool)
        if n > 2:
            space[1:-1] = (data[1:-1] == 0x20) & ~_NO_CUT[first[:-2]] & ~_NO_CUT[data[2:]] & ~edge[1:-2] & ~edge[2:-1]
        space[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(space)

    @staticmethod
    def _plain(data: np.ndarray) -> np.ndarray:
        """Bytes of printable ASCII, its line ends and Latin letters of U+00C0 to U+00FF; no start of a special token."""
        ok = _PLAIN[data]
        high = np.flatnonzero(data[:-1] == 0xC3)
        high = high[(data[high + 1] != 0x97) & (data[high + 1] != 0xB7)]
        ok[high] = ok[high + 1] = True
        ok[:-1] &= ~((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        return ok

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids."""
        raw = data.tobytes()
        if not self.cuts:
            return self._whole([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.uint32)
        start = self.starts(data, offsets)
        end = np.append(start[1:], len(data))
        # Long pieces go by their place, not by their bytes.
        long_ = end - start > LONGEST
        keys = self._keys(data, np.where(long_, 0, start), np.where(long_, 0, end))
        keys[long_] = mix(start[long_].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        keys, where, which = np.unique(keys, return_index=True, return_inverse=True)
        firsts, start, end, long_ = start, start[where], end[where], long_[where]
        known, sizes, ids = self.pieces.get(keys)
        known &= ~long_
        bad = np.concatenate(([0], np.cumsum(~self._plain(data))))
        hard = ~known & (long_ | (bad[end] > bad[start]))
        easy = ~known & ~hard
        table_sizes, table_ids = sizes.copy(), [ids]
        base = np.cumsum(sizes) - sizes
        for mask, coded in ((easy, self._easy), (hard, self._hard)):
            if mask.any():
                n, more = coded([raw[a:b] for a, b in zip(start[mask].tolist(), end[mask].tolist(), strict=True)])
                base[mask] = sum(map(len, table_ids)) + np.cumsum(n) - n
                table_sizes[mask] = n
                table_ids.append(more)
                short = ~long_[mask]
                if short.any():
                    self.pieces.put(keys[mask][short], n[short], more[spread((np.cumsum(n) - n)[short], n[short])])
        pool = np.concatenate(table_ids)
        # Pieces in order of the text, and their sums by text.
        size = table_sizes[which]
        first = np.searchsorted(firsts, offsets)
        total = np.concatenate(([0], np.cumsum(size)))
        return np.diff(total[first]), pool[spread(base[which], size)]

    def _hard(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._whole([p.decode() for p in pieces])

    def _easy(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = PARTS.findall(b"\0".join([*pieces, b""]).decode())
        number: dict[str, int] = {"\0": 0}
        at = np.array([number.setdefault(p, len(number)) for p in flat], np.int64)
        parts = list(number)[1:]
        coded = [p.encode() for p in parts]
        lengths = np.array([len(c) for c in coded], np.int64)
        ends = np.cumsum(lengths)
        keys = self._keys(np.frombuffer(b"".join(coded), np.uint8), ends - lengths, ends)
        known, sizes, ids = self.pieces.get(keys)
        place, new = np.cumsum(sizes) - sizes, np.flatnonzero(~known)
        if len(new):
            n, more = self._parts([parts[k] for k in new.tolist()])
            sizes[new], place[new] = n, len(ids) + np.cumsum(n) - n
            ids = np.concatenate((ids, more))
        sizes, place = np.concatenate(([0], sizes)), np.concatenate(([0], place))
        per = np.concatenate(([0], np.cumsum(sizes[at])))
        stops = np.flatnonzero(at == 0)
        whole = np.diff(per[stops], prepend=0)
        return whole, ids[spread(place[at], sizes[at])]


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks that a worker process runs, so what it keeps serves them all."""
    return Encoder(path)
