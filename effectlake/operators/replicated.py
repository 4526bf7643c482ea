"""Models fitted to all bootstrap replicates at once, and the estimators that rest on them.

A row's weight in a replicate is a Poisson draw of a hash of its key.  Rows are
multiplied only on their way into partial sums, or, where few rows differ, counted per
replicate first: a Newton step for all replicates is one grouped pass that brings a Gram matrix per replicate to the driver, and each
replicate's coefficients go back as arrays within expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learners import _clip
from .moments import cross_products, frame, inverted, solve, square
from .propensity import BinaryModel, normal_cdf, normal_density, with_outcome_models
from .resampling import draw, poisson_weight


#: Distinct rows are counted first where they are fewer than one in so many rows.
FEW = 4


class Replicates:
    """rows, each with its weight w in replicate b; b = 0 has the rows as they are."""

    def __init__(self, rows: DataFrame, key: str, replicates: int, seed: int):
        each = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
        self.n = replicates + 1
        self.rows = each.withColumn("w", F.when(F.col("b") == 0, 1).otherwise(poisson_weight(seed, "b", key))).where("w > 0")

    def counted(self, columns: Sequence[str], distinct: int, of: int) -> Replicates:
        """The same replicates by distinct values of ``columns``, counted in one pass and kept, where about ``distinct`` of ``of`` rows are few; otherwise these.  Every step is then a pass over those alone."""
        if distinct * FEW > of:
            return self
        out = copy(self)
        out.rows = self.rows.groupBy("b", *columns).agg(F.sum("w").alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
        return out

    def line(self, betas: np.ndarray, columns: Sequence[Column]) -> Column:
        """The replicate's coefficients times the columns."""
        return sum((F.get(F.lit(betas[:, j].tolist()), F.col("b")) * c for j, c in enumerate(columns)), F.lit(0.0))

    def fitted(self, y: Column, columns: Sequence[Column], link: str = "linear", rounds: int = 40, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients per replicate (NaN where a fit doesn't converge), and residual variances of linear ones."""
        k = len(columns)
        betas, spread = np.zeros((self.n, k)), np.full(self.n, np.nan)
        if link == "linear":
            shaped = self.rows.select("b", "w", *[c.alias(f"c{j}_") for j, c in enumerate([*columns, y])])
            pairs = [F.sum(F.col("w") * F.col(f"c{i}_") * F.col(f"c{j}_")) for i in range(k + 1) for j in range(i, k + 1)]
            for r in shaped.groupBy("b").agg(F.array(*pairs).alias("xx"), F.sum("w").alias("all_")).collect():  # a row per replicate
                m = square(r["xx"], k + 1)
                betas[r["b"]], _, rss = solve(m)
                spread[r["b"]] = rss / max(r["all_"] - k, 1)
            return betas, spread
        open_ = np.ones(self.n, bool)
        for _ in range(rounds):
            eta = self.line(betas, columns)
            if link == "logit":
                p = 1 / (1 + F.exp(-eta))
                weight, left = F.greatest(p * (1 - p), F.lit(1e-12)), y - p
            else:
                p, d = F.least(F.greatest(normal_cdf(eta), F.lit(1e-10)), F.lit(1 - 1e-10)), F.greatest(normal_density(eta), F.lit(1e-12))
                weight, left = d * d / (p * (1 - p)), (y - p) * d / (p * (1 - p))
            shaped = self.rows.select("b", "w", weight.alias("v_"), left.alias("l_"), *[c.alias(f"c{j}_") for j, c in enumerate(columns)])
            own = [F.col(f"c{j}_") for j in range(k)]
            pairs = [F.sum(F.col("w") * F.col("v_") * own[i] * own[j]) for i in range(k) for j in range(i, k)]
            pull = [F.sum(F.col("w") * F.col("l_") * c) for c in own]
            moved = 0.0
            for r in shaped.groupBy("b").agg(F.array(*pairs).alias("h"), F.array(*pull).alias("g")).collect():  # a row per replicate
                step = inverted(square(r["h"], k))[0] @ np.array(r["g"])
                if not np.isfinite(step).all() or np.abs(betas[r["b"]]).max() > 1e6:
                    open_[r["b"]] = False
                    continue
                betas[r["b"]] += step
                size = np.abs(step).max() / (1 + np.abs(betas[r["b"]]).max())
                moved = max(moved, size)
                open_[r["b"]] = size < 1e-5
            if moved < tolerance:
                break
        return np.where(open_[:, None], betas, np.nan), spread

    def means(self, values: dict[str, Column]) -> dict[str, np.ndarray]:
        """The weighted mean of each value per replicate."""
        out = {c: np.full(self.n, np.nan) for c in values}
        for r in self.rows.select("b", "w", *[v.alias(c) for c, v in values.items()]).groupBy("b").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in values]).collect():
            for c in values:
                out[c][r["b"]] = np.nan if r[c] is None else r[c]
        return out


def _summary(values: np.ndarray, alpha: float) -> tuple:
    """Estimate, error, percentile interval and two-sided p-value (twice the lesser share on a side of 0) of replicate 0 by the others."""
    drawn = values[1:][np.isfinite(values[1:])]
    first = float(values[0]) if np.isfinite(values[0]) else None
    if len(drawn) < 2:
        return first, None, None, None, None, len(drawn)
    low, high = np.quantile(drawn, [alpha / 2, 1 - alpha / 2])
    return first, float(drawn.std(ddof=1)), min(2 * float(min((drawn <= 0).mean(), (drawn >= 0).mean())), 1.0), float(low), float(high), len(drawn)


SUMMARY = "estimate double, se double, p_value double, ci_lower double, ci_upper double, replicates long"


def nonlinear_control_function(df: DataFrame, y: str, d: str, zs: Sequence[str], key: str, xs: Sequence[str] = (), link: str = "probit", replicates: int = 100, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The average marginal effect of d on a binary y: a probit or logit of y on d, the first stage's residual and xs; errors by replicates that fit both stages anew: estimate, se, p_value, interval, replicates, coefficient (of d), rho (of the residual), first_stage_f, n.  No rows give nulls."""
    names, insts = [f"x{i}" for i in range(len(xs))], [f"z{i}" for i in range(len(zs))]
    rows = frame(df, {"y": y, "d": d, **dict(zip(names, xs, strict=True)), **dict(zip(insts, zs, strict=True))}, (), [key])
    shape = f"{SUMMARY}, coefficient double, rho double, first_stage_f double, n long"
    seen = rows.agg(F.count(F.lit(1)), *[f(c) for c in ("d", *names, *insts) for f in (F.avg, F.stddev_pop)], F.approx_count_distinct(F.struct("y", "d", *names, *insts))).first()
    n = seen[0]
    if n <= len(xs) + len(zs) + 3:
        return df.sparkSession.createDataFrame([(*[None] * 5, 0, None, None, None, n)], shape)
    # Columns on a common scale: Newton steps start from 0.
    scale = {c: (seen[1 + 2 * i], seen[2 + 2 * i] or 1.0) for i, c in enumerate(("d", *names, *insts))}
    rows = rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        r = Replicates(rows, key, replicates, seed).counted(["y", "d", *names, *insts], seen[-1], n)
        exog = [F.lit(1.0), *map(F.col, insts), *map(F.col, names)]
        first, _ = r.fitted(F.col("d"), exog)
        residual = F.col("d") - r.line(np.nan_to_num(first), exog)
        columns = [F.lit(1.0), F.col("d"), residual, *map(F.col, names)]
        beta, _ = r.fitted(F.col("y"), columns, link)
        eta = r.line(np.nan_to_num(beta), columns)
        slope = normal_density(eta) if link == "probit" else F.exp(-eta) / (1 + F.exp(-eta)) ** 2
        effect = r.means({"m": slope})["m"] * beta[:, 1] / scale["d"][1]
        m = square(cross_products(rows, [F.lit(1.0), *map(F.col, names), *map(F.col, insts), F.col("d")]).first()["xx"], len(names) + len(insts) + 2)
        rss, rss0 = solve(m)[2], solve(m[np.ix_([*range(len(names) + 1), len(m) - 1], [*range(len(names) + 1), len(m) - 1])])[2]
        f = float((rss0 - rss) / len(zs) / (rss / (n - len(m) + 1))) if rss > 0 else None
        known = lambda v: float(v) if np.isfinite(v) else None
        r.rows.unpersist()
        out = (*_summary(effect, alpha), known(beta[0, 1] / scale["d"][1]), known(beta[0, 2] / scale["d"][1]), f, n)
        return df.sparkSession.createDataFrame([out], shape)
    finally:
        rows.unpersist()


def mediation_effects(
    df: DataFrame, y: str, t: str, m: str, key: str, xs: Sequence[str] = (), mediator: str = "linear", outcome: str = "linear", levels: tuple[float, float] = (0.0, 1.0), simulations: int = 10,
    replicates: int = 50, seed: int = 0, alpha: float = 0.05,
) -> DataFrame:
    """Natural direct and indirect effects of moving t from the first of ``levels`` to the second, by simulation: a row for total, direct, indirect and mediated (the share): estimate, se, p_value, interval, replicates, n.

    Models of mediator (on t, xs) and outcome (on t, mediator, xs) are linear or logit.
    Each row draws its mediator under either treatment ``simulations`` times from a hash
    of its key (the same draw under both), and the outcome model's means under them are
    averaged; replicates fit both models anew.  No rows give nulls."""
    names = [f"x{i}" for i in range(len(xs))]
    rows = frame(df, {"y": y, "t": t, "m": m, **dict(zip(names, xs, strict=True))}, (), [key])
    shape, kinds = f"effect string, {SUMMARY}, n long", ("total", "direct", "indirect", "mediated")
    of_m, of_y = ["m", "t", *names], ["y", "t", "m", *names]
    n, *few = rows.agg(F.count(F.lit(1)), *[F.approx_count_distinct(F.struct(*c)) for c in (of_m, of_y)]).first()
    if n <= len(xs) + 3:
        return df.sparkSession.createDataFrame([(k, *[None] * 5, 0, n) for k in kinds], shape)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        r = Replicates(rows, key, replicates, seed)
        x = [F.col(c) for c in names]
        by_m, by_y = r.counted(of_m, few[0], n), r.counted(of_y, few[1], n)
        a, spread = by_m.fitted(F.col("m"), [F.lit(1.0), F.col("t"), *x], mediator)
        b, _ = by_y.fitted(F.col("y"), [F.lit(1.0), F.col("t"), F.col("m"), *x], outcome)
        by_m.rows.unpersist()
        by_y.rows.unpersist()
        bad = ~(np.isfinite(a).all(1) & np.isfinite(b).all(1))
        a, b, sd = np.nan_to_num(a), np.nan_to_num(b), np.sqrt(np.nan_to_num(spread))
        r.rows = r.rows.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(simulations))))
        u, v = draw(seed + 1, "s", key), draw(seed + 2, "s", key)

        def under(level: float) -> Column:
            eta = r.line(a, [F.lit(1.0), F.lit(level), *x])
            if mediator == "logit":
                return F.when(u < 1 / (1 + F.exp(-eta)), 1.0).otherwise(0.0)
            return eta + F.get(F.lit(sd.tolist()), F.col("b")) * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)

        def mean(level: float, mediated: str) -> Column:
            eta = r.line(b, [F.lit(1.0), F.lit(level), F.col(mediated), *x])
            return 1 / (1 + F.exp(-eta)) if outcome == "logit" else eta

        r.rows = r.rows.withColumns({"m0_": under(levels[0]), "m1_": under(levels[1])})
        found = r.means({"y00": mean(levels[0], "m0_"), "y10": mean(levels[1], "m0_"), "y11": mean(levels[1], "m1_")})
        direct, indirect = found["y10"] - found["y00"], found["y11"] - found["y10"]
        direct[bad] = indirect[bad] = np.nan
        total = direct + indirect
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(np.abs(total) > 1e-10, indirect / total, np.nan)
        return df.sparkSession.createDataFrame([(k, *_summary(e, alpha), n) for k, e in zip(kinds, (total, direct, indirect, share), strict=True)], shape)
    finally:
        rows.unpersist()


def bayesian_doubly_robust(df: DataFrame, y: str, t: str, xs: Sequence[str], strata: Sequence[str] = (), draws: int = 200, prior_sd: float = 10.0, prior: tuple[float, float] = (1.0, 1.0), edge: float = 0.01, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The doubly robust mean for each draw of the propensities' posterior, all draws in one scan: estimate, se, interval, propensity_sd (the draws' own spread), draws, n.

    Propensities are logistic in xs with normal priors, or, with ``strata``, Beta
    posteriors per stratum.  The posterior's spread is widened for the outcome models:
    its variance becomes the greater of the influence function's, over n, and the draws'
    plus half of that.  Propensities are kept ``edge`` away from 0 and 1."""
    columns = {"y": y, "t": t, **{f"x{i}": x for i, x in enumerate(xs)}}
    names, rng = [f"x{i}" for i in range(len(xs))], np.random.default_rng(seed)
    rows = with_outcome_models(frame(df, columns, (), strata), "y", "t", names)
    if strata:
        counts = rows.groupBy(*strata).agg(F.sum("t").alias("a_"), F.count(F.lit(1)).alias("n_"), F.xxhash64(*[F.first(c) for c in strata]).alias("h_"))
        kinds = dict(counts.dtypes)

        def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                es = [np.random.default_rng([seed, int(h) & 0xFFFFFFFF]).beta(prior[0] + a, prior[1] + m - a, draws).tolist() for a, m, h in zip(batch.a_, batch.n_, batch.h_, strict=True)]
                yield batch[list(strata)].assign(es_=es, e_=(prior[0] + batch.a_) / (sum(prior) + batch.n_))

        table = counts.mapInPandas(drawn, ", ".join([*[f"`{c}` {kinds[c]}" for c in strata], "es_ array<double>", "e_ double"]))
        rows = rows.join(table, list(strata))
        each, centre = F.get("es_", F.col("s_")), F.col("e_")
    else:
        model = BinaryModel(rows, "t", names, ridge=1 / prior_sd**2)
        betas = rng.multivariate_normal(model.beta, model.cov, draws, method="eigh")
        line = sum((F.get(F.lit(betas[:, j].tolist()), F.col("s_")) * c for j, c in enumerate([F.lit(1.0), *map(F.col, names)])), F.lit(0.0))
        each, centre = 1 / (1 + F.exp(-line)), model.probability()
    score = lambda e: F.col("mu1") - F.col("mu0") + F.col("t") * (F.col("y") - F.col("mu1")) / e - (1 - F.col("t")) * (F.col("y") - F.col("mu0")) / (1 - e)
    own, n = rows.agg(F.var_pop(score(_clip(centre, edge))), F.count(F.lit(1))).first()
    many = rows.withColumn("s_", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    ates = np.array([r["m"] for r in many.groupBy("s_").agg(F.avg(score(_clip(each, edge))).alias("m")).collect()])  # a row per draw
    spread, outcome = float(ates.var()), own / n
    total = max(outcome, spread + outcome / 2)
    wide = ates.mean() + (ates - ates.mean()) * np.sqrt(total / spread) if spread > 0 else ates
    low, high = np.quantile(wide, [alpha / 2, 1 - alpha / 2])
    out = (float(wide.mean()), float(np.sqrt(total)), float(low), float(high), float(np.sqrt(spread)), draws, n)
    return df.sparkSession.createDataFrame([out], "estimate double, se double, ci_lower double, ci_upper double, propensity_sd double, draws long, n long")
