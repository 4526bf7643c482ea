"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch between the JVM and a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: A word of the word-based contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold BATCH_BYTES where the session asks for more: a Python worker and its JVM side hold a few batches each, of whatever rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def work_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent, a temporary folder becomes the checkpoint folder if
    all runs on this machine (tests); a cluster needs the setting."""
    bounded_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/effectlake-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The same rows read back from Parquet at ``path``: lineage ends there, and a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays.  ``lower`` does just that for texts of ASCII only, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with as many underscores before them as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
