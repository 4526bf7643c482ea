"""Marginal treatment effects by local instrumental variables.

The slope of the outcome in the propensity is a kernel regression at each point of a
grid.  An Epanechnikov weight is a quadratic, so its weighted sums are power sums; rows
are summed once into the bins that all windows' edges cut, and every window adds up its
own bins exactly.  No row ever meets the grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learners import _line
from .moments import LeastSquares, inferred, number
from .propensity import BinaryModel
from .ranks import place, quantiles
from .resampling import poisson_weight


def smoothed(curve: np.ndarray) -> np.ndarray:
    """A Gaussian mean of standard deviation 1 over the grid's points, cut at 4 and reflected at the ends; points that are not known stay so."""
    known = np.isfinite(curve)
    if known.sum() < 3:
        return curve
    whole = np.interp(np.arange(len(curve)), np.flatnonzero(known), curve[known])
    weights = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    out = np.convolve(np.pad(whole, 4, mode="symmetric"), weights / weights.sum(), "valid")
    return np.where(known, out, np.nan)


def window_slopes(sums: dict[int, np.ndarray], edges: np.ndarray, grid: np.ndarray, width: float) -> np.ndarray:
    """The kernel regression's slope at each point, from the bins' sums of powers 0 to 4 of (p - centre) / width and of y times powers 0 to 3."""
    out = np.full(len(grid), np.nan)
    for g, u in enumerate(grid):
        lo, hi = np.searchsorted(edges, u - width), np.searchsorted(edges, u + width)
        powers, with_y = np.zeros(5), np.zeros(4)
        for b in range(lo + 1, hi + 1):
            if b in sums:
                a = ((edges[b - 1] + edges[b]) / 2 - u) / width
                for j in range(5):
                    shift = np.array([math.comb(j, i) * a ** (j - i) for i in range(j + 1)])
                    powers[j] += shift @ sums[b][: j + 1]
                    if j < 4:
                        with_y[j] += shift @ sums[b][5 : 6 + j]
        s0, s1, s2 = powers[0] - powers[2], powers[1] - powers[3], powers[2] - powers[4]
        t0, t1 = with_y[0] - with_y[2], with_y[1] - with_y[3]
        det = s0 * s2 - s1 * s1
        if det > 1e-12 * max(s0 * s2, 1e-300):
            out[g] = (s0 * t1 - s1 * t0) / det / width
    return out


def local_iv(
    df: DataFrame, y: str, d: str, zs: Sequence[str], xs: Sequence[str] = (), key: str | None = None, replicates: int = 0, points: int = 50, bandwidth: float | None = None,
    trim: float = 0.01, seed: int = 0, alpha: float = 0.05,
) -> DataFrame:
    """G1: u, mte, se, p_value, interval, bandwidth, n: the local linear slope of y (freed of xs) in the propensity of d given zs and xs, smoothed over the grid, at ``points`` points between the propensity's ``trim`` quantiles.

    The default bandwidth is 1.06 min(sd, IQR / 1.34) n^-0.2, at least 0.01.  Errors are
    of ``replicates`` Poisson replicates by a hash of ``key``; without them null."""
    model = BinaryModel(df, d, [*zs, *xs])
    scored = df.withColumns({"p__": model.probability(), "y__": number(y)}).where("p__ IS NOT NULL AND y__ IS NOT NULL AND NOT isnan(y__)")
    low, high = quantiles(scored, "p__", [trim, 1 - trim]).first()["q"]
    own = scored.where(F.col("p__").between(low, high))
    if xs:
        own = own.withColumn("y__", F.col("y__") - _line(LeastSquares(own, "y__", xs).first()["line"], xs))
    n, sd, mean = own.agg(F.count(F.lit(1)), F.stddev_samp("p__"), F.avg("y__")).first()
    if bandwidth is None:
        q1, q3 = quantiles(own, "p__", [0.25, 0.75]).first()["q"]
        bandwidth = max(1.06 * min(sd or 0.0, (q3 - q1) / 1.34) * n**-0.2, 0.01) if (sd or 0.0) > 1e-10 else 0.1
    grid = np.linspace(low, high, points)
    edges = np.unique(np.concatenate([grid - bandwidth, grid + bandwidth]))
    middles = [0.0, *((edges[1:] + edges[:-1]) / 2).tolist()]
    rows = own.select(F.col("p__").alias("p"), (F.col("y__") - mean).alias("y"), *([F.col(key).alias("key")] if key else []))
    rows = rows.withColumn("bin", place(F.col("p"), edges))
    rows = rows.withColumn("v", (F.col("p") - F.get(F.lit(middles), F.col("bin"))) / bandwidth)
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates if key else 0))))
    w = F.when(F.col("b") == 0, 1).otherwise(poisson_weight(seed, "b", "key")) if key else F.lit(1)
    rows = rows.withColumn("w", w)
    power = lambda j: F.lit(1.0) if j == 0 else F.col("v") * power(j - 1)
    sums = rows.groupBy("b", "bin").agg(F.array(*[F.sum(F.col("w") * power(j)) for j in range(5)], *[F.sum(F.col("w") * F.col("y") * power(j)) for j in range(4)]).alias("s")).collect()  # bins x replicates
    curves: dict[int, dict[int, np.ndarray]] = {}
    for r in sums:
        curves.setdefault(r["b"], {})[r["bin"]] = np.array(r["s"])
    found = {b: smoothed(window_slopes(s, edges, grid, bandwidth)) for b, s in curves.items()}
    drawn = np.array([found[b] for b in found if b])
    se = np.nanstd(drawn, axis=0, ddof=1) if len(drawn) > 1 else np.full(points, np.nan)
    known = lambda v: float(v) if np.isfinite(v) else None
    out = [(float(u), known(m), known(s), float(bandwidth), n) for u, m, s in zip(grid, found[0], se, strict=True)]
    return inferred(df.sparkSession.createDataFrame(out, "u double, mte double, se double, bandwidth double, n long"), alpha, estimate="mte")


def policy_effects(curve: DataFrame, scored: DataFrame, p: str, moved: str, d: str) -> DataFrame:
    """Ate, att, atu and prte: the curve's mean; its means by the shares of treated above, and untreated below, each point; and by the gain in the share above each point when propensities p become ``moved``, from one aggregate of counts between the grid's points."""
    points = curve.orderBy("u").collect()  # the grid
    us, mte = np.array([r["u"] for r in points]), np.array([r["mte"] if r["mte"] is not None else np.nan for r in points])
    rows = scored.select(number(p).alias("p"), number(moved).alias("m"), number(d).alias("d"))
    counts = rows.groupBy(place(F.col("p"), us, True).alias("k"), place(F.col("m"), us, True).alias("m"), "d").agg(F.count(F.lit(1)).alias("n")).collect()  # grid x grid at most
    above = lambda k: (np.arange(len(us)) < k).astype(float)
    att = sum((r["n"] * above(r["k"]) for r in counts if r["d"] == 1), np.zeros(len(us)))
    atu = sum((r["n"] * (1 - above(r["k"])) for r in counts if r["d"] == 0), np.zeros(len(us)))
    gain = sum((r["n"] * (above(r["m"]) - above(r["k"])) for r in counts), np.zeros(len(us)))
    ok = np.isfinite(mte)
    mean = lambda w: float((w * mte)[ok].sum() / w[ok].sum()) if abs(w[ok].sum()) > 0 else None
    return curve.sparkSession.createDataFrame([(mean(np.ones(len(us))), mean(att), mean(atu), mean(gain))], "ate double, att double, atu double, prte double")
