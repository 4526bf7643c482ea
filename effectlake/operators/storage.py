"""Tables written in the folder that driver and executors share, where lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; where the setting is absent a temporary one, if all runs on this machine."""

    def __init__(self, spark: SparkSession) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.folder, self.tables = f"{base.rstrip('/')}/effectlake-{uuid.uuid4().hex}", 0

    def store(self, df: DataFrame) -> DataFrame:
        """The same rows, read back: a lost executor costs no recomputation, and labels of partitions stay as they were."""
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
