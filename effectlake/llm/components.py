"""Connected components by passing on the smallest label, with pointer jumping; all steps are joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, scratch: str) -> DataFrame:
    """links: x, y (integers).  node and comp, the smallest node that can be reached, for each node of a link.

    Each round a node takes the least label of its neighbours, and then its
    label's label, so paths shrink geometrically.  A hub's links are joined, never
    collected; what is aggregated per node is a minimum."""
    edges = stored(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{scratch}/edges")
    labels = stored(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("comp")), f"{scratch}/labels0")
    k = 0
    while True:
        k += 1
        heard = edges.join(labels, F.col("y") == F.col("node")).groupBy(F.col("x").alias("node_")).agg(F.min("comp").alias("near"))
        new = labels.join(heard, F.col("node") == F.col("node_"), "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("mid"))
        jump = labels.select(F.col("node").alias("mid_"), F.col("comp").alias("up"))
        new = stored(new.join(jump, F.col("mid") == F.col("mid_"), "left").select("node", "old", F.least("mid", F.coalesce("up", "mid")).alias("comp")), f"{scratch}/labels{k}")
        if new.where(F.col("old") != F.col("comp")).isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
