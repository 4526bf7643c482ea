"""Effects given latent factors and strata: scores from the covariance of covariates, and Gaussian mixtures by expectation-maximisation, a round of which is one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learners import _line, r_learner, t_learner
from .moments import LeastSquares, frame, gram_rows, inferred, number, square
from .propensity import with_propensity


def factor_scores(df: DataFrame, xs: Sequence[str], factors: int, method: str = "pca", rounds: int = 1_000, tolerance: float = 1e-10) -> DataFrame:
    """Df and factor_1, factor_2, ...: scores on the first principal components (pca), or posterior means of a factor model's factors (fa), which is fitted to the covariance matrix; both are linear in xs, from one pass.

    Rows with a null covariate have null scores.  A factor's sign makes its greatest weight positive."""
    row = gram_rows(df, {f"c{i}": x for i, x in enumerate(xs)}).first()
    k, n = len(xs), row["n"]
    if n < 2 or not 0 < factors <= k:
        raise ValueError("too few rows, or more factors than covariates")
    cov = square(row["xx"], k + 1)[1:, 1:] / n
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :factors]
    if method == "pca":
        weights = top
    else:
        sd = np.sqrt(np.diag(cov))
        sd[sd == 0] = 1.0
        r = cov / np.outer(sd, sd)
        v, e = np.linalg.eigh(r)
        loads = e[:, ::-1][:, :factors] * np.sqrt(np.maximum(v[::-1][:factors], 1e-6))
        noise = np.maximum(1 - (loads**2).sum(1), 1e-3)
        for _ in range(rounds):
            scaled = loads / noise[:, None]
            inner = np.linalg.inv(np.eye(factors) + loads.T @ scaled)
            beta = inner @ scaled.T  # posterior means from data
            second = inner + beta @ r @ beta.T
            new = r @ beta.T @ np.linalg.inv(second)
            noise = np.maximum(np.diag(r - new @ beta @ r), 1e-6)
            done = np.abs(new - loads).max() < tolerance
            loads = new
            if done:
                break
        scaled = loads / noise[:, None]
        weights = (np.linalg.inv(np.eye(factors) + loads.T @ scaled) @ scaled.T).T / sd[:, None]
    weights = weights * np.sign(weights[np.abs(weights).argmax(0), np.arange(factors)])
    score = lambda w: sum((float(a) * (number(x) - float(m)) for a, x, m in zip(w, xs, row["at"], strict=True)), F.lit(0.0))
    return df.withColumns({f"factor_{j + 1}": score(weights[:, j]) for j in range(factors)})


def factor_cate(df: DataFrame, y: str, t: str, xs: Sequence[str], factors: int, method: str = "pca", learner: str = "t", squares: bool = False) -> DataFrame:
    """Df, its factors and cate, by a T- or R-learner linear in xs and factors, with ``squares`` also in the factors' squares and products, which xs alone do not span."""
    own = factor_scores(df, xs, factors, method)
    names = [f"factor_{j + 1}" for j in range(factors)]
    if squares:
        more = {f"factor_{i + 1}_{j + 1}": F.col(names[i]) * F.col(names[j]) for i in range(factors) for j in range(i, factors)}
        own, names = own.withColumns(more), [*names, *more]
    if learner == "t":
        return t_learner(own, y, t, [*xs, *names])
    return r_learner(with_propensity(own, t, xs, clip=0.01), y, t, [*xs, *names]).drop("p")


class Mixture:
    """A mixture of ``k`` normals with covariances of their own, fitted to complete rows of xs: shares, means, covariances, loglik, rounds, converged."""

    def __init__(self, df: DataFrame, xs: Sequence[str], k: int, rounds: int = 100, tolerance: float = 1e-7, floor: float = 1e-6):
        self.xs, self.k, p = list(xs), k, len(xs)
        names = [f"x{i}" for i in range(p)]
        row = gram_rows(df, dict(zip(names, xs, strict=True))).first()
        n = row["n"]
        if n <= k:
            raise ValueError("too few rows")
        cov = square(row["xx"], p + 1)[1:, 1:] / n
        self.mean, self.sd = np.array(row["at"]), np.sqrt(np.maximum(np.diag(cov), 1e-300))
        rows = frame(df, dict(zip(names, xs, strict=True))).select(*[((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(names, self.mean, self.sd, strict=True)]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            r = cov / np.outer(self.sd, self.sd)
            first = np.linalg.eigh(r)[1][:, -1]
            along = sum((float(a) * F.col(c) for a, c in zip(first, names, strict=True)), F.lit(0.0))
            cuts = rows.select(along.alias("v")).stat.approxQuantile("v", [(2 * j + 1) / (2 * k) for j in range(k)], 0.001)
            self.shares, self.means, self.covs = np.full(k, 1 / k), np.outer(cuts, first), np.stack([r / k + floor * np.eye(p)] * k)
            self.loglik, self.converged, self.rounds = -np.inf, False, 0
            pairs = [(a, b) for a in range(p) for b in range(a, p)]
            while self.rounds < rounds and not self.converged:
                own = rows.select(*names, F.array(*self._logs([F.col(c) for c in names])).alias("l"))
                own = own.withColumn("top", F.array_max("l")).withColumn("d", F.transform("l", lambda v: F.exp(v - F.col("top"))))
                own = own.withColumn("all_", F.aggregate("d", F.lit(0.0), lambda a, v: a + v))
                sums = []
                for j in range(k):
                    q = F.col("d")[j] / F.col("all_")
                    at = [F.col(c) - float(m) for c, m in zip(names, self.means[j], strict=True)]
                    sums += [F.sum(q), *[F.sum(q * a) for a in at], *[F.sum(q * at[a] * at[b]) for a, b in pairs]]
                got = own.agg(F.sum(F.col("top") + F.log("all_")), *sums).first()
                like, got = got[0] / n, np.array(got[1:]).reshape(k, -1)
                for j in range(k):
                    w = max(got[j, 0], 1e-10)
                    step, second = got[j, 1 : 1 + p] / w, square(got[j, 1 + p :], p) / w
                    self.shares[j], self.means[j] = w / n, self.means[j] + step
                    self.covs[j] = second - np.outer(step, step) + floor * np.eye(p)
                self.rounds, self.converged, self.loglik = self.rounds + 1, abs(like - self.loglik) < tolerance, like
        finally:
            rows.unpersist()

    def _logs(self, columns: Sequence[Column]) -> list[Column]:
        out = []
        for share, mean, cov in zip(self.shares, self.means, self.covs, strict=True):
            root = np.linalg.inv(np.linalg.cholesky(cov))
            z = [c - float(m) for c, m in zip(columns, mean, strict=True)]
            square_ = sum((sum((float(root[i, j]) * z[j] for j in range(i + 1)), F.lit(0.0)) ** 2 for i in range(len(z))), F.lit(0.0))
            out.append(F.lit(float(np.log(max(share, 1e-300)) + np.log(np.diag(root)).sum())) - square_ / 2)
        return out

    def stratum(self) -> Column:
        """The likeliest component, from 0 on; null where a covariate is."""
        logs = F.array(*self._logs([(number(x) - float(m)) / float(s) for x, m, s in zip(self.xs, self.mean, self.sd, strict=True)]))
        return (F.array_position(logs, F.array_max(logs)) - 1).cast("int")


def mixture_cate(df: DataFrame, y: str, t: str, xs: Sequence[str], k: int, rounds: int = 100) -> DataFrame:
    """Df, stratum (the likeliest component of a mixture of xs) and cate, by a T-learner of its own in each stratum; null where a stratum lacks an arm."""
    own = df.withColumn("stratum", Mixture(df, xs, k, rounds).stratum())
    fits = {(r["stratum"], r[t]): r["line"] for r in LeastSquares(own, y, xs, ["stratum", t]).table.collect()}  # two rows a stratum
    gap = F.lit(None).cast("double")
    for j in range(k):
        if (j, 0) in fits and (j, 1) in fits:
            gap = F.when(F.col("stratum") == j, _line(np.array(fits[j, 1]) - np.array(fits[j, 0]), xs)).otherwise(gap)
    return own.withColumn("cate", gap)


def mixture_ate(effects: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The strata's mean effects weighted by their sizes: estimate, se (as if effects were known), n_strata, n."""
    per = effects.where("cate IS NOT NULL").groupBy("stratum").agg(F.avg("cate").alias("m"), F.var_samp("cate").alias("v"), F.count(F.lit(1)).alias("n"))
    out = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("estimate"), (F.sqrt(F.sum(F.col("n") * F.coalesce("v", F.lit(0.0)))) / F.sum("n")).alias("se"), F.count(F.lit(1)).alias("n_strata"), F.sum("n").alias("n"))
    return inferred(out, alpha)
