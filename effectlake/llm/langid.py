"""Language identification with a bit-sliced Bloom filter of n-grams.

Each language has a Bloom filter of its commonest n-grams, and the filters are
sliced: entry i of one table holds bit i of every language's filter, so the AND
of the few entries that an n-gram hashes to is the mask of all languages that
hold it.  A text's count for a language is the number of n-grams whose mask has
its bit.  Of n n-grams a filter with false-positive rate f lets (n - c) f
through that it doesn't hold, so c is corrected to (hits - n f) / (1 - f).

Training takes a bounded sample of labelled documents (``SAMPLE``), picked by a
hash of the id; n-grams are counted by Spark, and the commonest ``GRAMS`` of each
language come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches
from .textbytes import TO_LOWER, mix, slices, sums

#: Labelled documents that training takes, about.
SAMPLE = 20_000
GRAMS = 3_000
SLOTS, HASHES = 1 << 16, 3
#: Parts that a language's n-grams are ranked in.
SALTS = 64
UNDETERMINED = "und"
HELD_OUT = 5
#: A-Z as a-z, letters beyond ASCII as they are, all else a space.
_CLASS = np.where((TO_LOWER >= 0x61) & (TO_LOWER <= 0x7A) | (np.arange(256) >= 0x80), TO_LOWER, 0x20).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each byte the four bytes from there as a number, and whether they lie in one document and start or hold no blank run."""
    d = _CLASS[data].astype(np.uint32)
    n = len(d)
    g = np.zeros(n, np.uint32)
    ok = np.zeros(n, bool)
    if n >= 4:
        g[: n - 3] = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
        blank = d == 0x20
        ok[: n - 3] = ~(blank[:-3] & blank[1:-2]) & ~(blank[1:-2] & blank[2:-1])
        last = offsets[1:]
        for k in (1, 2, 3):
            ok[np.maximum(last - k, 0)[last > 0]] = False
            ok[np.maximum(last - k, offsets[:-1])[last > offsets[:-1]]] = False
    return g, ok


def positions(g: np.ndarray) -> list[np.ndarray]:
    h = mix(g.astype(np.uint64) + np.uint64(0x51ED270B))
    bits = np.uint64(SLOTS.bit_length() - 1)
    return [((h >> (bits * np.uint64(k))) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    languages: list[str]  # the commonest first
    table: np.ndarray  # words of 64 languages x SLOTS
    false_rate: np.ndarray

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts, languages x documents, and the number of n-grams."""
        g, ok = grams(data, offsets)
        at = positions(g)
        n = sums(ok, offsets)
        out = np.zeros((len(self.languages), len(n)))
        for w, words in enumerate(self.table):
            mask = words[at[0]] & words[at[1]] & words[at[2]]
            mask[~ok] = 0
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits = sums(((mask >> np.uint64(k - 64 * w)) & np.uint64(1)).astype(bool), offsets)
                f = self.false_rate[k]
                out[k] = (hits - n * f) / (1 - f)
        return out, n


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and lang of labelled documents outside the held-out fifth, about ``sample`` of them."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold, F.lit(0)) != 0))
    share = min(1.0, sample / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) < int(share * (1 << 40))).select("text", F.col("lang").cast("string").alias("lang"))


def train(rows: DataFrame, top: int = GRAMS) -> Model | None:
    """rows: text, lang.  None where there is nothing to learn from.  Every label of the rows is learned.  What comes to the driver is bounded by the sample that the rows are: a label has a document of it, and no more n-grams than its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            found: dict[str, list[np.ndarray]] = {}
            for row, data, offsets in slices(batch.column("text")):
                g, ok = grams(data, offsets)
                for k in range(len(offsets) - 1):
                    a, b = offsets[k], offsets[k + 1]
                    found.setdefault(langs[row + k], []).append(g[a:b][ok[a:b]])
            for lang, parts in found.items():
                values, times = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.astype(np.int64)), pa.array(times.astype(np.int64))], ["lang", "gram", "n"])

    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    largest = counted.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.col("all").desc(), "lang").collect()
    languages = [r["lang"] for r in largest]
    # The commonest of a language are among the commonest of each of its SALTS parts, so no task ranks a whole language.
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "gram"))
    parts = counted.withColumn("part", F.pmod("gram", F.lit(SALTS))).withColumn("k", best("lang", "part")).where(F.col("k") <= top).drop("k", "part")
    rows_ = parts.withColumn("k", best("lang")).where(F.col("k") <= top).select("lang", "gram").collect() if languages else []
    counted.unpersist()
    if not languages:
        return None
    table = np.zeros((-(-len(languages) // 64), SLOTS), np.uint64)
    rate = np.zeros(len(languages))
    commonest: dict[str, list[int]] = {lang: [] for lang in languages}
    for r in rows_:
        commonest[r["lang"]].append(r["gram"])
    for k, lang in enumerate(languages):
        slots = np.unique(np.concatenate(positions(np.array(commonest[lang], np.uint32))))
        table[k // 64, slots] |= np.uint64(1 << (k % 64))
        rate[k] = min(0.5, (len(slots) / SLOTS) ** HASHES)
    return Model(languages, table, rate)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text when nothing was learned.  The score is the best language's part of all
    corrected counts; ties go to the language with more training text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            names, scores = [], []
            for row, data, offsets in slices(batch.column("text")):
                own = lettered[row : row + len(offsets) - 1]
                if m is None:
                    names += [UNDETERMINED] * len(own)
                    scores += [0.0] * len(own)
                    continue
                counts = np.maximum(m.counts(data, offsets)[0], 0.0)
                best = counts.argmax(0)
                part = counts[best, np.arange(len(own))] / np.maximum(counts.sum(0), 1e-12)
                names += [m.languages[b] if x else UNDETERMINED for b, x in zip(best, own, strict=True)]
                scores += list(np.where(own, np.minimum(part, 1.0), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT, F.lit(0)) == 0).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), "text",
    )
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model of the labelled rows that are not held out.

    Rows without text or label teach nothing; a null or letterless text is ``und`` with
    score 0; a null doc_id counts as held out; repeated rows each give a row; no rows
    give none.  Columns other than doc_id, text and lang are not read."""
    bounded_batches(docs.sparkSession)
    return predict(docs, train(training_rows(docs)))
