"""Replicates from hashes: a draw depends on the seed, the replicate and the key alone, so results are the same however rows are partitioned."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import number

#: Cumulative probabilities of the Poisson distribution of mean 1, from 0 on.
_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)]).tolist()


def draw(seed: int, *keys: str | Column) -> Column:
    """A number from 0 to 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def poisson_weight(seed: int, *keys: str | Column) -> Column:
    """A Poisson(1) weight: how often a row is in a replicate.

    A plain sum of comparisons, which generated code holds, with the hash taken once."""
    u = draw(seed, *keys)
    return sum(((u >= c).cast("int") for c in _POISSON), F.lit(0))


def percentile_interval(replicates: DataFrame, replicate: str, estimate: str, alpha: float = 0.05) -> DataFrame:
    """Per further column of ``replicates``: the estimate (replicate 0), its error and percentile interval from the others."""
    keys = [c for c in replicates.columns if c not in (replicate, estimate)]
    other = F.when(F.col(replicate) > 0, F.col(estimate))
    aggs = [
        F.max(F.when(F.col(replicate) == 0, F.col(estimate))).alias("estimate"), F.stddev_samp(other).alias("se"),
        F.percentile(other, F.lit([alpha / 2, 1 - alpha / 2])).alias("q"), F.count(other).alias("replicates"),
    ]
    out = replicates.groupBy(*keys).agg(*aggs) if keys else replicates.agg(*aggs)
    return out.select(*keys, "estimate", "se", F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"), "replicates")


def bootstrap_means(df: DataFrame, y: str, t: str, key: str, replicates: int, seed: int = 0) -> DataFrame:
    """BOOT: a difference in means per replicate (0 is that of the rows as they are) with Poisson(1) weights.

    Rows are multiplied only on their way into the partial sums: a task passes on
    one row per replicate and arm."""
    each = df.select(F.col(key).alias("key"), F.col(t).alias("t"), number(y).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))
    w = each.select("t", "y", "replicate", F.when(F.col("replicate") == 0, 1).otherwise(poisson_weight(seed, "replicate", "key")).alias("w"))
    mean = lambda a: F.sum(F.when(F.col("t") == a, F.col("w") * F.col("y"))) / F.sum(F.when(F.col("t") == a, F.col("w")))
    return w.groupBy("replicate").agg((mean(1) - mean(0)).alias("estimate"))
