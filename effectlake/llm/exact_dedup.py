"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text.
It lives in files under its path, with the number of buckets beside them, so any
later session opens it again by that path.  A new batch is reduced to one row per digest, anti-joined with the index by
sort-merge (the index side is read bucket by bucket and never shuffled) and the
digests that were not there are appended.  Only digests and ids move, texts
never do.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, shuffle_parts, stored, work_dir

#: At most this many groups are broadcast as hot ones, since a hot group has more than this share of all rows.
HOT_GROUPS = 4096


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the digest of the text, A-Z lower-cased; a null text is an empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(ascii_lower(body), 256)).alias("digest"))


class DigestIndex:
    """Digests seen so far, with the id of the row that stays for each.

    * Within a batch the largest id stays; a digest that the index holds already keeps its older row.
    * A null id ranks below all others, so it stays only where all ids of its group are null.
    * Rows that repeat an id and its text are one document: they stay or go together.
    * An empty batch appends nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Opens the index under ``path``, or makes a new one of ``buckets`` buckets there."""
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:32]}"
        stated = self._stated_buckets()
        self.buckets = stated or buckets or max(8, shuffle_parts(spark))
        if not stated:
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(f"{self.path}/about")
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
            )
        spark.catalog.refreshTable(self.name)

    def _stated_buckets(self) -> int | None:
        try:
            return self.spark.read.schema("buckets int").json(f"{self.path}/about").first()[0]
        except AnalysisException:
            return None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, batch: DataFrame) -> None:
        """batch: doc_id and digest.  Appends the digests that are new."""
        found = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        found = found.join(self.rows().hint("merge").select("digest"), "digest", "left_anti")
        found.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def close(self) -> None:
        """Takes the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def assign(rows: DataFrame, index: DataFrame, scratch: str) -> DataFrame:
    """Each row of ``rows`` (doc_id, digest) with keep_id from the index and the size of its group.

    Groups with more than 1/HOT_GROUPS of all rows are joined by broadcast: there
    can be no more than HOT_GROUPS of them, whatever the input.  All other groups
    are small, and meet their rows in a sort-merge join."""
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = stored(sizes.join(index.hint("merge"), "digest"), f"{scratch}/groups")
    limit = (groups.agg(F.sum("group_size")).first()[0] or 0) // HOT_GROUPS + 1
    hot = F.broadcast(groups.where(F.col("group_size") > limit))
    cold = groups.where(F.col("group_size") <= limit)
    few = rows.join(hot, "digest")
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(cold.hint("merge"), "digest")
    return few.unionByName(rest)


def exact_dedup(docs: DataFrame, scratch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The documents enter a new index in two batches, the larger ids first, so that
    of equal texts the row with the largest id stays.

    A null text counts as empty; a null doc_id is below every other, and its row stays
    only where no row of the text has an id (keep_id null); rows that repeat id and text
    stay or go together, each counted in group_size; other columns are not read; no rows give none."""
    spark = docs.sparkSession
    scratch = scratch or work_dir(spark)
    rows = stored(digests(docs), f"{scratch}/digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    index = DigestIndex(spark, f"{scratch}/index")
    index.ingest(rows.where(F.col("doc_id") > middle))
    index.ingest(rows.where(~F.coalesce(F.col("doc_id") > middle, F.lit(False))))
    return assign(rows, index.rows(), scratch).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
