"""Binary models, the estimators that weight by them, and the permutation test."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .experiments import CLIP, hajek_ate, small_df
from .moments import cross_products, frame, grouped, inferred, join_by, number, square
from .ranks import quantiles, running

#: Exact enumeration is refused above this many relabellings.
MOST_RELABELLINGS = 200_000


def normal_cdf(z: Column) -> Column:
    """The normal distribution function as a column, to 1e-7 or better (a rational form of the error function after Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


class BinaryModel:
    """A logistic or probit model by Newton steps, each one pass of weighted cross-products over distinct covariate patterns, which are counted once and kept.

    beta (the intercept first), cov, converged, rounds.  ``ridge`` is the penalty's
    weight (half the squared coefficients but the intercept); 0 is the unpenalised model."""

    def __init__(self, df: DataFrame, t: str | Column, xs: Sequence[str | Column], ridge: float = 0.0, link: str = "logit", rounds: int = 50, tolerance: float = 1e-10):
        names = [f"x{i}" for i in range(len(xs))]
        rows = frame(df, {"t": t, **dict(zip(names, xs, strict=True))})
        patterns = rows.groupBy(*names).agg(F.sum("t").alias("a"), F.count(F.lit(1)).alias("n")) if names else rows.agg(F.sum("t").alias("a"), F.count(F.lit(1)).alias("n"))
        patterns = patterns.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            seen = patterns.agg(F.sum("n"), F.sum("a"), *[x for c in names for x in (F.sum(F.col(c) * F.col("n")) / F.sum("n"), F.stddev_pop(c))]).first()
            if not seen[0] or not 0 < seen[1] < seen[0]:
                raise ValueError("both outcomes need rows")
            self.n = int(seen[0])
            mean, sd = np.array(seen[2::2], float), np.array([s if s else 1.0 for s in seen[3::2]], float)
            z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(names, mean, sd, strict=True)]
            cols, k = [F.lit(1.0), *z], len(names) + 1
            beta, penalty = np.zeros(k), np.diag([0.0, *(ridge / sd**2)])
            self.converged, self.rounds = False, 0
            while self.rounds < rounds and not self.converged:
                eta = sum((float(b) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
                if link == "logit":
                    p = 1 / (1 + F.exp(-eta))
                    w = F.greatest(p * (1 - p), F.lit(1e-12))
                    left = (F.col("a") / F.col("n") - p) / w
                else:
                    p = F.least(F.greatest(normal_cdf(eta), F.lit(1e-10)), F.lit(1 - 1e-10))
                    d = F.greatest(normal_density(eta), F.lit(1e-12))
                    w, left = d * d / (p * (1 - p)), (F.col("a") / F.col("n") - p) / d
                m = square(cross_products(patterns, [*cols, left], weight=w * F.col("n")).first()["xx"], k + 1)
                hessian = m[:-1, :-1] + penalty
                step = np.linalg.pinv(hessian, hermitian=True) @ (m[:-1, -1] - penalty @ beta)
                beta, self.rounds = beta + step, self.rounds + 1
                self.converged = bool(np.abs(step).max() < tolerance)
        finally:
            patterns.unpersist()
        to = np.diag([1.0, *(1 / sd)])
        to[0, 1:] = -mean / sd
        self.beta, self.cov, self.link, self.xs = to @ beta, to @ np.linalg.pinv(hessian, hermitian=True) @ to.T, link, list(xs)

    def eta(self) -> Column:
        return sum((float(b) * number(c) for b, c in zip(self.beta[1:], self.xs, strict=True)), F.lit(float(self.beta[0])))

    def probability(self, clip: float = 0.0) -> Column:
        p = 1 / (1 + F.exp(-self.eta())) if self.link == "logit" else normal_cdf(self.eta())
        return F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip)) if clip else p


def logit(df: DataFrame, t: str, xs: Sequence[str], ridge: float = 0.0, rounds: int = 50, tolerance: float = 1e-10) -> np.ndarray:
    """O1, O2: coefficients, the intercept first, of a logistic model."""
    return BinaryModel(df, t, xs, ridge, "logit", rounds, tolerance).beta


def with_propensity(df: DataFrame, t: str, xs: Sequence[str], ridge: float = 0.0, clip: float = CLIP) -> DataFrame:
    """O1, O2: df and p, the modelled probability of treatment, kept ``clip`` away from 0 and 1.  A penalty of 1 / C is that of a regularised model of strength C."""
    return df.withColumn("p", BinaryModel(df, t, xs, ridge).probability(clip))


def model_table(df: DataFrame, t: str, xs: Sequence[str], ridge: float = 0.0, link: str = "logit", alpha: float = 0.05) -> DataFrame:
    """O1: a row per coefficient: term, estimate, se, p_value, interval, n, whether the steps converged."""
    m = BinaryModel(df, t, xs, ridge, link)
    rows = [(c, float(b), float(np.sqrt(max(v, 0))), m.n, m.converged) for c, b, v in zip(["intercept", *xs], m.beta, np.diag(m.cov), strict=True)]
    return inferred(df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, n long, converged boolean"), alpha)


def propensity_fit(scored: DataFrame, t: str, p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """O1: n, McFadden's R2, and the share of (treated, control) pairs ordered rightly by p (ties half), from counts per distinct p."""
    rows = frame(scored, {"t": t, "p": p}, by)
    like = F.when(F.col("t") == 1, F.log("p")).otherwise(F.log1p(-F.col("p")))
    sums = grouped(rows, by, F.count(F.lit(1)).alias("n"), F.sum("t").alias("n1"), F.sum(like).alias("ll"))
    null = F.col("n1") * F.log(F.col("n1") / F.col("n")) + (F.col("n") - F.col("n1")) * F.log1p(-F.col("n1") / F.col("n"))
    ties = rows.groupBy(*by, "p").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b"))
    pairs = grouped(running(ties, "p", "b", by), by, F.sum(F.col("a") * (F.col("before") + F.col("b") / 2)).alias("u"))
    return join_by(sums, pairs, by).select(*by, "n", (1 - F.col("ll") / null).alias("pseudo_r2"), (F.col("u") / F.col("n1") / (F.col("n") - F.col("n1"))).alias("auc"))


def separation(scored: DataFrame, p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """How near to 0 and 1 the propensities come: counts within 1e-10, below 0.01 and above 0.99, range, spread and their ratio to the mean."""
    rows = frame(scored, {"p": p}, by)
    v = F.col("p")
    return grouped(
        rows, by, F.count(F.lit(1)).alias("n"), F.count_if((v < 1e-10) | (v > 1 - 1e-10)).alias("n_separated"), F.count_if(v < 0.01).alias("n_low"), F.count_if(v > 0.99).alias("n_high"),
        F.min(v).alias("least"), F.max(v).alias("greatest"), F.stddev_pop(v).alias("spread"), (F.stddev_pop(v) / F.avg(v)).alias("variation"),
    )


def stabilized_weights(df: DataFrame, t: str, p: str = "p") -> DataFrame:
    """O3: df and w: the share of the row's arm over the probability of its arm."""
    share = F.avg(number(t)).alias("share__")
    both = join_by(df, df.agg(share), ())
    return both.withColumn("w", F.when(F.col(t) == 1, F.col("share__") / F.col(p)).otherwise((1 - F.col("share__")) / (1 - F.col(p)))).drop("share__")


def trimmed(scored: DataFrame, trim: tuple[float, float], p: str = "p") -> DataFrame:
    """V4: the rows whose p lies between its exact quantiles ``trim``, linearly interpolated."""
    low, high = quantiles(scored, p, list(trim)).first()["q"]
    return scored.where(F.col(p).between(low, high))


def ipw_observational(df: DataFrame, y: str, t: str, xs: Sequence[str], trim: tuple[float, float] | None = None, by: Sequence[str] = (), stabilize: bool = False, alpha: float = 0.05) -> DataFrame:
    """The weighted difference by modelled propensities, with n_trimmed and n_clipped.

    ``trim`` drops rows beyond those quantiles of p.  Within an arm stable weights
    are the plain ones times a constant, so ``stabilize`` leaves the normalised
    means as they are."""
    model = BinaryModel(df, t, xs)
    scored = df.withColumn("p", model.probability())
    kept = trimmed(scored, trim) if trim else scored
    clipped = F.count_if((F.col("p") < CLIP) | (F.col("p") > 1 - CLIP))
    counts = join_by(grouped(scored, by, F.count(F.lit(1)).alias("all_")), grouped(kept, by, F.count(F.lit(1)).alias("kept_"), clipped.alias("n_clipped")), by)
    kept = kept.withColumn("p", F.least(F.greatest("p", F.lit(CLIP)), F.lit(1 - CLIP)))
    weight = None
    if stabilize:
        share = grouped(kept, by, F.avg(number(t)).alias("share__"))
        kept = join_by(kept, share, by)
        weight = F.when(F.col(t) == 1, F.col("share__")).otherwise(1 - F.col("share__"))
    out = join_by(hajek_ate(kept, y, t, "p", by, weight, alpha), counts, by)
    return out.withColumn("n_trimmed", F.col("all_") - F.col("kept_")).drop("all_", "kept_")


def with_outcome_models(df: DataFrame, y: str, t: str, xs: Sequence[str]) -> DataFrame:
    """Df, mu0 and mu1: least squares of y on xs in each arm, predicted for all rows; both arms share their passes.  An arm without rows is an error."""
    from .moments import LeastSquares

    fits = {r[t]: r["line"] for r in LeastSquares(df, y, xs, [t]).table.where(F.col(t).isin(0, 1)).collect()}  # one row per arm
    if set(fits) != {0, 1}:
        raise ValueError("both arms need rows")
    line = lambda b: sum((float(c) * number(x) for c, x in zip(b[1:], xs, strict=True) if np.isfinite(c)), F.lit(float(b[0])))
    return df.withColumns({"mu0": line(fits[0]), "mu1": line(fits[1])})


def outcome_model_fit(df: DataFrame, y: str, t: str, xs: Sequence[str]) -> DataFrame:
    """Per arm n, R2 and root mean squared error of its outcome model."""
    from .moments import LeastSquares

    table = LeastSquares(df, y, xs, [t]).table
    return table.select(F.col(t).cast("long").alias("arm"), "n", F.when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss")).alias("r2"), F.sqrt(F.col("rss") / F.col("n")).alias("rmse"))


def tmle(df: DataFrame, y: str, t: str, p: str = "p", mu0: str = "mu0", mu1: str = "mu1", by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Targeted estimate with a linear fluctuation, whose one step solves the score: estimate, se (efficient influence function), epsilon, n, interval."""
    rows = frame(df, {"y": y, "t": t, "p": p, "mu0": mu0, "mu1": mu1}, by)
    h1, h0 = 1 / F.col("p"), -1 / (1 - F.col("p"))
    h = F.when(F.col("t") == 1, h1).otherwise(h0)
    r = F.col("y") - F.when(F.col("t") == 1, F.col("mu1")).otherwise(F.col("mu0"))
    step = grouped(rows, by, (F.sum(h * r) / F.sum(h * h)).alias("epsilon"))
    both = join_by(rows, step, by)
    gap = F.col("mu1") - F.col("mu0") + F.col("epsilon") * (h1 - h0)
    own = both.select(*by, "epsilon", gap.alias("gap"), (h * (r - F.col("epsilon") * h)).alias("s"))
    out = grouped(own, by, F.avg("gap").alias("estimate"), F.sqrt((F.var_pop(F.col("gap") + F.col("s")) + F.avg("s") ** 2) / F.count(F.lit(1))).alias("se"), F.max("epsilon").alias("epsilon"), F.count(F.lit(1)).alias("n"))
    return inferred(out.withColumn("df", small_df()), alpha, "df").drop("df")


def logistic_fluctuation(df: DataFrame, y: str, q: str | Column, h: str | Column, rounds: int = 50, tolerance: float = 1e-10) -> float:
    """The coefficient of h in a logistic model of y (0 to 1) with offset logit q, by Newton steps of two sums each."""
    rows = frame(df, {"y": y, "q": q, "h": h}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        e = 0.0
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-(F.log(F.col("q") / (1 - F.col("q"))) + e * F.col("h"))))
            g, i = rows.agg(F.sum(F.col("h") * (F.col("y") - p)), F.sum(F.col("h") ** 2 * p * (1 - p))).first()
            if not i:
                break
            e += g / i
            if abs(g / i) < tolerance:
                break
        return e
    finally:
        rows.unpersist()


def permutation_test(df: DataFrame, y: str, t: str, key: str, replicates: int | None, seed: int = 0, alternative: str = "two-sided") -> DataFrame:
    """Mean difference and its p-value, (count + 1) / (replicates + 1), under relabellings that keep the number treated.

    alternative: two-sided, greater or less.  In each replicate the rows of the n1
    smallest digests of (seed, replicate, key) are treated.  The digest's first four
    digits cut a replicate into 65,536 ranges: those below the one that holds the
    n1-th digest count whole, and only that one is ranked, so no task holds a
    replicate.  Keys are unique.  Without ``replicates`` all relabellings are counted,
    which small tables allow; the p-value is then their share."""
    base = df.select(number(y).alias("y"), number(t).alias("t"), F.col(key).cast("string").alias("key")).where("y IS NOT NULL AND t IS NOT NULL AND key IS NOT NULL")
    seen = base.agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("n1"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("t")).alias("s1")).first()
    n, n1, total = seen["n"], int(seen["n1"] or 0), seen["sy"]
    if not 0 < n1 < n:
        raise ValueError("both arms need rows")
    observed = seen["s1"] / n1 - (total - seen["s1"]) / (n - n1)
    slack = abs(observed) * 1e-9
    if replicates is None:
        if math.comb(n, n1) > MOST_RELABELLINGS:
            raise ValueError(f"{math.comb(n, n1)} relabellings: state a number of replicates")
        ys = np.array([r[0] for r in base.select("y").collect()])  # comb(n, n1) is small, so n is
        gaps = np.array([ys[list(c)].sum() for c in itertools.combinations(range(n), n1)])
        gaps = gaps / n1 - (total - gaps) / (n - n1)
        far = {"two-sided": np.abs(gaps) >= abs(observed) - slack, "greater": gaps >= observed - slack, "less": gaps <= observed + slack}[alternative]
        return df.sparkSession.createDataFrame([(float(observed), float(far.mean()), int(far.sum()), len(gaps))], "estimate double, p_value double, n_extreme long, replicates long")
    rows = base.select("y", "key").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rows = rows.select("b", "y", F.md5(F.concat_ws(":", F.lit(str(seed)), "b", "key").cast("binary")).alias("h")).withColumn("range", F.substring("h", 1, 4))
    ranges = rows.groupBy("b", "range").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("s"))
    run = Window.partitionBy("b").orderBy("range")
    ranges = ranges.select("b", "range", "s", "c", F.sum("c").over(run).alias("upto")).persist(StorageLevel.MEMORY_AND_DISK)
    whole = ranges.where(F.col("upto") <= n1).groupBy("b").agg(F.sum("s").alias("s"))
    edge = ranges.where((F.col("upto") > n1) & (F.col("upto") - F.col("c") < n1)).select(F.col("b").alias("b_"), F.col("range").alias("range_"), (n1 - F.col("upto") + F.col("c")).alias("take"))
    # One edge range per replicate at most.
    last = rows.join(F.broadcast(edge), (F.col("b") == F.col("b_")) & (F.col("range") == F.col("range_")))
    last = last.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("h"))).where("k <= take").groupBy("b").agg(F.sum("y").alias("s"))
    sums = whole.unionByName(last).groupBy("b").agg(F.sum("s").alias("s"))
    gap = F.col("s") / n1 - (F.lit(total) - F.col("s")) / (n - n1)
    # The tolerance makes relabellings equal to the observed one count whatever the order of sums.
    far = {"two-sided": F.abs(gap) >= abs(observed) - slack, "greater": gap >= observed - slack, "less": gap <= observed + slack}[alternative]
    try:
        k, m = sums.agg(F.sum(far.cast("long")), F.count(F.lit(1))).first()
    finally:
        ranges.unpersist()
    return df.sparkSession.createDataFrame([(float(observed), (k + 1) / (m + 1), k, m)], "estimate double, p_value double, n_extreme long, replicates long")
