"""Periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words of smallest period q, at least four periods
long, that no neighbouring word extends.  The words of a batch of documents are one
string, with a word of its own after each document so that no run crosses an edge.

Periods below 8 are read off by comparing the string with itself.  For periods from
t to 2t, t = 8, 16, 32, ..., positions are selected by the hash of the t words that
begin there: i is in the set if the least hash of the windows at i to i + t is at i
or at i + t.  Whether a position is selected depends on the 2t words after it alone,
so a run of period q repeats its selected positions every q words, and two
consecutive positions of equal context (2t words) are a period apart.  Windows
within a run of period t/4 or less - all found at smaller scales or by comparison -
are left out of the selection: they would select every position, and no run of period t
to 2t lies in them.  Any other stretch of 3t words holds a selected position among
its first t, and a run of period q >= t has 3t + q words, so each run proposes its
period.  Proposals are verified word by word; equal hashes alone never make a run.

A text is one row and is handled whole; there is no shuffle.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .textbytes import mix

#: Periods below it are found by direct comparison; the first scale of the sets.
DIRECT = 8
#: A run has at least so many periods.
PERIODS = 4
#: Bytes of text whose words are handled as one string; a longer text is a string of its own.
SLICE = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NONE = np.uint64(2**64 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true that have at least ``least`` places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _small(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of periods below DIRECT: start, end, period."""
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(DIRECT, len(w))):
        s, e = _stretches(w[:-q] == w[q:], (PERIODS - 1) * q)
        e = e + q
        smaller = np.concatenate(found)  # a stretch of a multiple of its smallest period has been found with that
        new = ~np.isin(s * (len(w) + 1) + e, smaller[:, 0] * (len(w) + 1) + smaller[:, 1])
        found.append(np.stack([s[new], e[new], np.full(new.sum(), q)], axis=1))
    return tuple(np.concatenate(found).T)


def synchronising_set(names: np.ndarray, t: int, without: np.ndarray) -> np.ndarray:
    """Selected positions, by the hashes ``names`` of the t words from each position on; ``without`` marks windows that aren't to be selected."""
    ids = np.where(without, _NONE, names)
    least, size = ids, 1
    while size < t:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:-1], ids[t:])  # over t + 1 windows
    return np.flatnonzero((least != _NONE) & ((least == ids[: len(least)]) | (least == ids[t:])))


def runs_of(w: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of at least PERIODS periods in the string w, whose documents are w[bounds[k] : bounds[k + 1] - 1] with a word of their own after each."""
    start, end, period = _small(w)
    sizes = np.diff(bounds) - 1
    own, at = w, np.arange(len(w))  # the words still in play and their places in w
    names, t, of = mix(w.astype(np.uint64) * _ODD + np.uint64(1)), 1, np.repeat(np.arange(len(sizes)), sizes + 1)
    while len(sizes) and PERIODS * max(t, DIRECT) <= sizes.max():
        if t >= DIRECT:
            keep = sizes[of] >= PERIODS * t
            if not keep.all():
                # A window's name at the end of a document runs into the next one; it holds the document's own word, so it equals no other.
                own, at, names, of = own[keep], at[keep], names[keep[: len(names)]], of[keep]
            whole = len(own) - t + 1
            names = names[:whole]
            without = np.zeros(whole + 1, np.int64)
            inner = (period * 4 <= t) & (end - start >= t)
            a, b = np.searchsorted(at, start[inner]), np.searchsorted(at, end[inner])
            there = b - a == (end - start)[inner]  # runs of documents still in play
            np.add.at(without, a[there], 1)
            np.add.at(without, np.minimum(b[there] - t + 1, whole), -1)
            if whole > t:
                chosen = synchronising_set(names, t, np.cumsum(without)[:-1] > 0)
                chosen = chosen[chosen + 2 * t <= len(own)]
                context = mix(names[chosen] * _ODD + names[chosen + t])
                order = np.argsort(context, kind="stable")
                i, j = chosen[order[:-1]], chosen[order[1:]]
                near = (context[order[:-1]] == context[order[1:]]) & (j - i >= t) & (j - i < 2 * t)
                new = _verified(w, bounds, at[i[near]], (j - i)[near], of[i[near]])
                start, end, period = (np.concatenate(p) for p in zip((start, end, period), new, strict=True))
        if len(names) <= t:
            break
        names = mix(names[:-t] * _ODD + names[t:])
        t *= 2
    return start, end, period


def _verified(w: np.ndarray, bounds: np.ndarray, at: np.ndarray, period: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of PERIODS periods or more among those that the proposals (a place and a period) lie in, from the words themselves."""
    found = [np.zeros((0, 3), np.int64)]
    order = np.lexsort((at, period, doc))
    at, period, doc = at[order], period[order], doc[order]
    cuts = np.flatnonzero(np.diff(doc) | np.diff(period)) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), len(at)]):
        if a == b:
            continue
        lo, hi, q = bounds[doc[a]], bounds[doc[a] + 1] - 1, period[a]
        s, e = _stretches(w[lo : hi - q] == w[lo + q : hi], (PERIODS - 1) * q)
        places = at[a:b] - lo
        hit = np.searchsorted(places, s) < np.searchsorted(places, e)
        found.append(np.stack([s[hit] + lo, e[hit] + q + lo, np.full(hit.sum(), q)], axis=1))
    return tuple(np.concatenate(found).T)


def _slices(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text or b"") > SLICE:
            yield held
            held, size = [], 0
        held.append((text or b"").split())  # bytes.split() parts at \x20 and \x09-\x0D
        size += len(text or b"")
    if held:
        yield held


def _tabled(least_words: int, least_exponent: int):  # noqa: ANN202
    def rows(words: list[list[bytes]]) -> tuple[list, list, list]:
        ids: dict[bytes, int] = defaultdict(itertools.count().__next__)
        sizes = np.array([len(x) for x in words])
        bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
        w = np.empty(bounds[-1], np.int64)
        inside = np.ones(len(w), bool)
        inside[bounds[1:] - 1] = False
        w[inside] = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
        w[bounds[1:] - 1] = len(ids) + np.arange(len(words))
        start, end, period = runs_of(w, bounds)
        long = (end - start >= least_words) & (end - start >= least_exponent * period)
        order = np.lexsort((period[long], start[long]))
        start, end, period = start[long][order], end[long][order], period[long][order]
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, start + period, 1)
        np.add.at(cover, end, -1)
        kept = np.cumsum(cover)[:-1] == 0
        first = np.searchsorted(start, bounds)
        runs, strongest, collapsed = [], [], []
        for k, mine in enumerate(words):
            lo, a, b = bounds[k], first[k], first[k + 1]
            own = list(zip((start[a:b] - lo).tolist(), (end[a:b] - start[a:b]).tolist(), period[a:b].tolist(), strict=True))
            best = None
            for s, n, q in own:
                if best is None or n * best[2] > best[1] * q:
                    best = (s, n, q)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            strongest.append(best and dict(zip(("start", "length", "period"), best, strict=True)))
            collapsed.append(b" ".join(itertools.compress(mine, kept[lo : lo + len(mine)].tolist()) if own else mine))
        return runs, strongest, collapsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, row = batch.column("text").cast(pa.binary()).to_pylist(), 0
            for words in _slices(texts):
                runs, strongest, collapsed = rows(words)
                n = len(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), pa.array([len(x) for x in words], pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(strongest, RUN), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )
                row += n

    return run


def detect(docs: DataFrame, least_words: int = 6, least_exponent: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period: by start, then period), strongest (the run of greatest length / period; of equals the first) and collapsed: the words left when those after a run's first period go, joined by one space.

    Words are runs of anything but ASCII white space.  ``least_exponent`` is 4 at least:
    shorter runs need not propose themselves.  A null or empty text has no words and no
    runs (strongest null, collapsed empty); a null doc_id stays null; repeated rows each
    give a row; other columns of ``docs`` are not read; no rows give none."""
    if least_exponent < PERIODS:
        raise ValueError(f"runs of fewer than {PERIODS} periods are not searched for")
    bounded_batches(docs.sparkSession)
    shape = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tabled(least_words, least_exponent), shape)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli (1000 length / period, rounded down), and the sha256 of the runs' lines and of what is left."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    s = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), s["start"].alias("start"), s["length"].alias("length"), s["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, the text of one document in ten being rewritten to repeat: with h the crc32 of the decimal doc_id and g = h div 10, word i from a = g % n on is word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    own = docs.select(F.col("doc_id"), "text", F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("w_"), F.expr("crc32(string(doc_id)) div 10").alias("g_"))
    n = F.size("w_")
    own = own.withColumn("a_", F.when(n > 0, F.col("g_") % n)).withColumn("p_", F.expr("1 + (size(w_) - a_) div (3 + g_ % 8)"))
    moved = F.expr("transform(w_, (x, i) -> if(i < a_, x, w_[int(a_ + (i - a_) % p_)]))")
    return own.select("doc_id", F.when(F.col("a_").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))
