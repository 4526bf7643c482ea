"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or not at all on every document, and their
votes overlap.  The votes are counted by pattern over all documents (at most
3**len(LABELLERS) rows reach the driver), and expectation-maximisation on those
counts estimates how often each labeller votes each way on good and on bad
documents, without any given label.  The posterior of a document's pattern is
its weak label.  A linear scorer of hashed byte trigrams and binned statistics
then learns the weak labels of a bounded sample and scores every document, so
that it also judges where the labellers are silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .textbytes import SPACE, slices, sums, words

#: Documents that the scorer learns from, about.
SAMPLE = 4_000
BUCKETS = 1 << 11
#: Weight of the shares of trigrams against the binned statistics.
TRIGRAM_SCALE = 4.0
#: Below one half: a clean document lost is worse than a bad one kept.
THRESHOLD = 0.35
#: name: (statistic, good up to, bad from); between the two the labeller is silent.
LABELLERS = {
    "symbols": ("symbol_share", 0.02, 0.03),
    "bars": ("bar_share", 0.002, 0.01),
    "lone_marks": ("mark_share", 0.05, 0.1),
    "shouting": ("upper_share", 0.25, 0.4),
    "exclamations": ("bang_share", 0.01, 0.02),
    "repetition": ("repeat_share", 0.1, 0.2),
    "few_words": ("sameness", 0.6, 0.85),
    "few_letters": ("other_share", 0.15, 0.25),
}
STATISTICS = [s for s, _, _ in LABELLERS.values()]
BINS = np.array([0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.85])
N_FEATURES = BUCKETS + len(STATISTICS) * (len(BINS) + 1)

_A = np.arange(256)
_UPPER, _LOWER, _HIGH = (_A >= 0x41) & (_A <= 0x5A), (_A >= 0x61) & (_A <= 0x7A), _A >= 0x80
_SYMBOL = np.isin(_A, list(b"#$%&*^~@\\{}<>=_+"))
_MARK = ~(_UPPER | _LOWER | _HIGH | SPACE | ((_A >= 0x30) & (_A <= 0x39)))
_BAR, _BANG = _A == ord("|"), _A == ord("!")


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Statistics x documents, all from 0 to 1, and the number of words."""
    filled = np.maximum(sums(~SPACE[data], offsets), 1)
    upper, lower, high = (sums(c[data], offsets) for c in (_UPPER, _LOWER, _HIGH))
    letters = upper + lower + high
    h, _, first = words(data, offsets)
    n = np.diff(first)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][n > 0]] = False
    repeats = sums(same, first) / np.maximum(n, 1)
    kinds = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]) if len(n) else n
    blank = SPACE[data]
    alone = np.zeros(len(data), bool)
    alone[1:-1] = _MARK[data[1:-1]] & blank[:-2] & blank[2:]
    marks = sums(alone, offsets) / np.maximum(n, 1)
    # Long texts repeat common words, so distinct words are held against what their number allows.
    sameness = np.where(n >= 20, 1 - np.minimum(1, kinds / np.maximum(n, 1) ** 0.8), 0.0)
    return np.stack([
        sums(_SYMBOL[data], offsets) / filled, sums(_BAR[data], offsets) / filled, np.minimum(marks, 1), upper / np.maximum(letters, 1), sums(_BANG[data], offsets) / filled,
        repeats, sameness, 1 - letters / filled,
    ]), n


def votes(stats: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Labellers x documents: 0 silent, 1 good, 2 bad.  Without words all are silent; a handful of words is too few to vote bad for shares of letters."""
    limits = np.array([[g, b] for _, g, b in LABELLERS.values()])
    out = np.where(stats <= limits[:, :1], 1, np.where(stats >= limits[:, 1:], 2, 0))
    short = np.array([s in ("upper_share", "other_share") for s in STATISTICS])
    out[short[:, None] & (n_words < 5)[None, :]] = 1
    out[:, n_words == 0] = 0
    return out


def _patterns(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(len(v))[:, None]).sum(0)


def pattern_counts(docs: DataFrame) -> DataFrame:
    """pattern, n over all documents; counted per batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_patterns(votes(*statistics(data, offsets))) for _, data, offsets in slices(batch.column(0))]
            if found:
                p, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], ["pattern", "n"])

    return docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of being good for each pattern, and the labellers' rates: class (bad, good) x labeller x vote.

    A document is first taken for bad if any labeller says so."""
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = np.where((v == 2).any(1), 0.1, 0.95)
    rates = np.zeros((2, len(LABELLERS), 3))
    for _ in range(rounds):
        weight = np.stack([1 - good, good]) * counts
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        for c in range(3):
            rates[:, :, c] = weight @ (v == c)
        # A vote never seen has a small rate; without it one stray pattern would settle all.
        rates = (rates + 0.5) / (rates.sum(2, keepdims=True) + 1.5)
        log = np.log(prior)[:, None] + np.log(rates[:, np.arange(len(LABELLERS))[:, None], v.T]).sum(1)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good, rates


def features(data: np.ndarray, offsets: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram at each byte (BUCKETS where there is none), and the bin of each statistic."""
    n = len(data)
    d = data.astype(np.uint32)
    at = np.full(n, BUCKETS, np.int64)
    if n >= 3:
        g = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
        at[:-2] = (g * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
        for k in (1, 2):
            ends = offsets[1:] - k
            at[ends[ends >= offsets[:-1]]] = BUCKETS
    bins = np.searchsorted(BINS, stats, "right") + np.arange(len(stats))[:, None] * (len(BINS) + 1)
    return at, bins


def vectors(data: np.ndarray, offsets: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Documents x N_FEATURES + 1: shares of trigram buckets, bins of statistics, and the constant."""
    at, bins = features(data, offsets, stats)
    x = np.zeros((len(offsets) - 1, N_FEATURES + 1), np.float32)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        x[k, :BUCKETS] = np.bincount(at[a:b], minlength=BUCKETS + 1)[:BUCKETS] / max(1, b - a) * TRIGRAM_SCALE
        x[k, BUCKETS + bins[:, k]] = 1
    x[:, -1] = 1
    return x


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights of the logistic scorer, by gradient steps with momentum."""
    w, step = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = 0.9 * step + (p - y) @ x / max(1, len(x)) + 1e-5 * w
        w = w - 0.5 * step
    return w


def linear_scores(data: np.ndarray, offsets: np.ndarray, stats: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The scorer's value for each document, from 0 to 1."""
    at, bins = features(data, offsets, stats)
    grams = sums(np.append(w[:BUCKETS], 0.0)[at], offsets, np.float64) / np.maximum(np.diff(offsets), 1)
    return 1 / (1 + np.exp(-np.clip(grams * TRIGRAM_SCALE + w[BUCKETS:-1][bins].sum(0) + w[-1], -500, 500)))


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray]:
    """The posterior of each pattern that occurs, and the scorer's weights.

    The scorer is fitted in one task, on about ``sample`` documents that a hash of id
    and text picks, whatever the number of documents; of each a vector of
    N_FEATURES numbers comes there, not its text.  All else covers every document."""
    bounded_batches(docs.sparkSession)
    rows = pattern_counts(docs).collect()
    patterns, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    good = expectation_maximisation(patterns, counts)[0] if len(rows) else np.zeros(0)
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    share = int(min(1.0, sample / max(1.0, counts.sum())) * (1 << 40))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for row, data, offsets in slices(batch.column("text")):
                stats, n = statistics(data, offsets)
                x, p = vectors(data, offsets, stats), _patterns(votes(stats, n)).tolist()
                kept = np.flatnonzero(n > 0).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([keys[row + k] for k in kept], pa.int64()), pa.array([posterior[p[k]] for k in kept], pa.float64()), pa.array([x[k].tobytes() for k in kept], pa.binary())], ["key", "p", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((k, p, x) for batch in batches for k, p, x in zip(*[batch.column(c).to_pylist() for c in ("key", "p", "x")], strict=True))
        w = fit(np.frombuffer(b"".join(x for _, _, x in held), np.float32).reshape(-1, N_FEATURES + 1), np.array([p for _, p, _ in held], np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(float).tolist()], pa.list_(pa.float64()))], ["w"])

    key = F.xxhash64("text", "doc_id")
    picked = docs.where(F.col("text").isNotNull()).select(key.alias("key"), "text").where(F.pmod("key", F.lit(1 << 40)) < share)
    found = picked.mapInArrow(vectorise, "key long, p double, x binary").repartition(1).mapInArrow(learn, "w array<double>").collect()
    return posterior, np.array(found[0][0]) if found else np.zeros(N_FEATURES + 1)


def score(docs: DataFrame, model: tuple[dict[int, float], np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, n_words, votes (a digit per labeller: 0 silent, 1 good, 2 bad), weak_label, score, keep.

    A null, empty or blank text has no votes, score 0 and isn't kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, w = shared.value
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for _, data, offsets in slices(batch.column("text")):
                stats, n = statistics(data, offsets)
                v = votes(stats, n)
                cols[0] += n.tolist()
                cols[1] += ["".join(map(str, x)) for x in v.T.tolist()]
                cols[2] += [posterior.get(p, 0.5) for p in _patterns(v).tolist()]
                cols[3] += np.where(n > 0, linear_scores(data, offsets, stats, w), 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                ["doc_id", "text_key", "n_words", "votes", "weak_label", "score"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    scored = own.mapInArrow(run, "doc_id long, text_key long, n_words long, votes string, weak_label double, score double")
    return scored.withColumn("keep", F.col("score") >= threshold)


def classify(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs)).drop("text_key")


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, in one pass over them: no row is shuffled.

    A null or empty text is scored like any other (it has none of the words); repeated
    rows are kept or dropped alike; all columns pass as they are, whatever their names;
    no rows give none."""
    text = docs.columns.index("text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, w = model.value
        for batch in batches:
            kept: list[np.ndarray] = []
            for _, data, offsets in slices(batch.column(text)):
                stats, n = statistics(data, offsets)
                kept.append((n > 0) & (linear_scores(data, offsets, stats, w) >= threshold))
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
