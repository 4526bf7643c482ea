"""Heterogeneous effects by linear learners, double machine learning, and effects on unconditional quantiles.

Models are fitted from cross-products and applied as column expressions, so that
each learner is a few aggregates and its effects a column of the input.  Cross-
fitting needs one pass for all folds: a fold's training sums are the total less
its own."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import LeastSquares, centred, cross_products, each_row, frame, grouped, inferred, inverted, join_by, number, square
from .panels import unit_means
from .propensity import BinaryModel, with_outcome_models
from .ranks import quantiles, weighted_quantiles
from .resampling import poisson_weight


#: Widths, as shares of the rows on either side, of the brackets around quantiles in replicates.
SLACKS = (0.05, 0.2, 1.0)


def _line(beta: Sequence[float], xs: Sequence[str | Column]) -> Column:
    return sum((float(b) * number(x) for b, x in zip(beta[1:], xs, strict=True) if np.isfinite(b)), F.lit(float(beta[0])))


def s_learner(df: DataFrame, y: str, t: str, xs: Sequence[str]) -> DataFrame:
    """Df and cate: least squares of y on t, xs and their products; the effect is t's part of it."""
    beta = LeastSquares(df, y, [t, *xs, *[number(t) * number(x) for x in xs]]).first()["line"]
    return df.withColumn("cate", _line([beta[1], *beta[2 + len(xs) :]], xs))


def t_learner(df: DataFrame, y: str, t: str, xs: Sequence[str]) -> DataFrame:
    """Df and cate: the difference of the two arms' linear predictions."""
    return with_outcome_models(df, y, t, xs).withColumn("cate", F.col("mu1") - F.col("mu0")).drop("mu0", "mu1")


def t_learner_ate(df: DataFrame, y: str, t: str, xs: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """The mean of the T-learner's effects, with the error from the arms' residual variances, s1^2 / n1 + s0^2 / n0."""
    own = with_outcome_models(df, y, t, xs)
    rows = frame(own, {"y": y, "t": t, "mu0": "mu0", "mu1": "mu1"})
    e = F.col("y") - F.when(F.col("t") == 1, F.col("mu1")).otherwise(F.col("mu0"))
    arm = lambda f, a: f(F.when(F.col("t") == a, e))
    var = arm(F.var_samp, 1) / arm(F.count, 1) + arm(F.var_samp, 0) / arm(F.count, 0)
    return inferred(rows.agg(F.avg(F.col("mu1") - F.col("mu0")).alias("estimate"), F.sqrt(var).alias("se"), F.count(F.lit(1)).alias("n")), alpha)


def x_learner(df: DataFrame, y: str, t: str, xs: Sequence[str], p: str = "p") -> DataFrame:
    """Df and cate: imputed effects of either arm, each fitted on xs, weighted by the propensity p (clipped to 0.01-0.99)."""
    imputed = with_outcome_models(df, y, t, xs).withColumn("gap_", F.when(F.col(t) == 1, number(y) - F.col("mu0")).otherwise(F.col("mu1") - number(y)))
    fits = {r[t]: r["line"] for r in LeastSquares(imputed, "gap_", xs, [t]).table.where(F.col(t).isin(0, 1)).collect()}  # one row per arm
    e = F.least(F.greatest(F.col(p), F.lit(0.01)), F.lit(0.99))
    return df.withColumn("cate", e * _line(fits[0], xs) + (1 - e) * _line(fits[1], xs))


def r_learner(df: DataFrame, y: str, t: str, xs: Sequence[str], p: str = "p", ridge: float = 0.0) -> DataFrame:
    """Df and cate: linear in xs, fitted to the outcome's residual on the treatment's residual times (1, xs)."""
    mu = LeastSquares(df, y, xs).first()["line"]
    rows, means = centred(frame(df, {"y": y, "t": t, "p": p, **{f"x{i}": x for i, x in enumerate(xs)}}), [f"x{i}" for i in range(len(xs))])
    rt = F.col("t") - F.col("p")
    ry = F.col("y") - F.lit(float(mu[0] + sum(b * m for b, m in zip(mu[1:], means.values(), strict=True)))) - sum((float(b) * F.col(f"x{i}") for i, b in enumerate(mu[1:])), F.lit(0.0))
    cols = [rt, *[rt * F.col(f"x{i}") for i in range(len(xs))], ry]
    m = square(cross_products(rows, cols).first()["xx"], len(cols))
    beta = inverted(m[:-1, :-1] + ridge * np.eye(len(cols) - 1))[0] @ m[:-1, -1]
    beta[0] -= sum(b * c for b, c in zip(beta[1:], means.values(), strict=True))
    return df.withColumn("cate", _line(beta, xs))


def effect_summary(effects: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Mean, spread and range of the column cate, its number of rows, and the error of the mean as if effects were known."""
    out = grouped(effects, by, F.avg("cate").alias("estimate"), (F.stddev_samp("cate") / F.sqrt(F.count("cate"))).alias("se"), F.stddev_samp("cate").alias("spread"), F.min("cate").alias("least"), F.max("cate").alias("greatest"), F.count("cate").alias("n"))
    return inferred(out, alpha)


class Folds:
    """Rows with their fold, and linear fits of several targets on xs, each fold's from all other rows: predictions as columns through a small table of coefficients."""

    def __init__(self, df: DataFrame, columns: dict[str, str | Column], xs: Sequence[str | Column], key: str | Column, folds: int, keep: Sequence[str] = ()):
        """key: a column whose hash deals rows into folds, or an expression that names the fold, from 0 on."""
        self.names, self.folds = [f"x{i}" for i in range(len(xs))], folds
        fold = (F.pmod(F.xxhash64(F.col(key)), F.lit(folds)) if isinstance(key, str) else key).cast("int")
        own = frame(df.withColumn("fold__", fold), {**dict(zip(self.names, xs, strict=True)), **columns}, ["fold__"], keep)
        self.rows, self.means = centred(own, self.names)

    def fitted(self, targets: Sequence[str], where: Column | None = None, ridge: float = 0.0) -> list[Column]:
        """A prediction of each target, from the rows ``where`` of the other folds."""
        rows = self.rows if where is None else self.rows.where(where)
        x, k = [F.lit(1.0), *map(F.col, self.names)], len(self.names) + 1
        sums = {r["fold__"]: square(r["xx"], k + len(targets)) for r in cross_products(rows, [*x, *map(F.col, targets)], ["fold__"]).collect()}  # a row per fold
        total, betas = sum(sums.values()), np.zeros((self.folds, len(targets), k))
        for f in range(self.folds):
            m = total - sums.get(f, 0.0) + np.diag([0.0, *[ridge] * (k - 1), *[0.0] * len(targets)])
            for j in range(len(targets)):
                keep = [*range(k), k + j]
                own = m[np.ix_(keep, keep)]
                betas[f, j] = inverted(own[:-1, :-1])[0] @ own[:-1, -1]
        return [sum((F.get(F.lit(betas[:, j, i].tolist()), F.col("fold__")) * c for i, c in enumerate(x)), F.lit(0.0)) for j in range(len(targets))]


def _clip(p: Column, edge: float) -> Column:
    return F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))


def double_ml(df: DataFrame, y: str, t: str, xs: Sequence[str], key: str | Column, folds: int = 5, binary: bool = True, ridge: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """C4: cross-fitted partialling out: theta is the slope of the outcome's residual on the treatment's, with the influence function's error.

    Folds come from a hash of the key.  Models are linear; a binary treatment's
    predictions are clipped to 0.01-0.99."""
    own = Folds(df, {"y": y, "t": t}, xs, key, folds)
    e, m = own.fitted(["t", "y"], ridge=ridge)
    r = own.rows.select("fold__", (F.col("t") - (_clip(e, 0.01) if binary else e)).alias("rt"), (F.col("y") - m).alias("ry"))
    return inferred(_partialled(r), alpha)


def _partialled(r: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    theta = grouped(r, by, (F.sum(F.col("rt") * F.col("ry")) / F.sum(F.col("rt") ** 2)).alias("estimate"), F.avg(F.col("rt") ** 2).alias("j_"))
    both = join_by(r, theta, by)
    psi = F.col("rt") * (F.col("ry") - F.col("estimate") * F.col("rt")) / F.col("j_")
    return grouped(both, by, F.max("estimate").alias("estimate"), F.sqrt(F.var_samp(psi) / F.count(F.lit(1))).alias("se"), F.count(F.lit(1)).alias("n"))


def double_ml_continuous(df: DataFrame, y: str, d: str, xs: Sequence[str], key: str | Column, folds: int = 5, ridge: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """The same for a continuous treatment: a row for all (fold null) and one per fold, with the models' out-of-fold R2."""
    own = Folds(df, {"y": y, "t": d}, xs, key, folds)
    e, m = own.fitted(["t", "y"], ridge=ridge)
    r = own.rows.select("fold__", "t", "y", (F.col("t") - e).alias("rt"), (F.col("y") - m).alias("ry"))
    fit = lambda a, b: 1 - F.sum(F.col(a) ** 2) / (F.var_pop(b) * F.count(F.lit(1)))
    every = join_by(_partialled(r), r.agg(fit("rt", "t").alias("r2_treatment"), fit("ry", "y").alias("r2_outcome")), ()).withColumn("fold", F.lit(None).cast("long"))
    each = join_by(_partialled(r, ["fold__"]), r.groupBy("fold__").agg(fit("rt", "t").alias("r2_treatment"), fit("ry", "y").alias("r2_outcome")), ["fold__"])
    each = each.withColumn("fold", F.col("fold__").cast("long")).drop("fold__")
    return inferred(every.unionByName(each), alpha)


def interactive_dml(df: DataFrame, y: str, t: str, xs: Sequence[str], key: str | Column, folds: int = 5, target: str = "ate", edge: float = 0.025, alpha: float = 0.05) -> DataFrame:
    """Cross-fitted outcome models per arm and propensity, clipped to 0.025-0.975; the mean of the doubly robust score over all rows ("ate") or over the treated ("atte")."""
    own = Folds(df, {"y": y, "t": t}, xs, key, folds)
    (g0,), (g1,), (e,) = own.fitted(["y"], F.col("t") == 0), own.fitted(["y"], F.col("t") == 1), own.fitted(["t"])
    r = own.rows.select("y", "t", g0.alias("g0"), g1.alias("g1"), _clip(e, edge).alias("p"))
    t_, y_ = F.col("t"), F.col("y")
    n = F.count(F.lit(1))
    if target == "ate":
        psi = F.col("g1") - F.col("g0") + t_ * (y_ - F.col("g1")) / F.col("p") - (1 - t_) * (y_ - F.col("g0")) / (1 - F.col("p"))
        return inferred(r.agg(F.avg(psi).alias("estimate"), F.sqrt(F.var_samp(psi) / n).alias("se"), n.alias("n")), alpha)
    a = t_ * (y_ - F.col("g0")) - (1 - t_) * F.col("p") / (1 - F.col("p")) * (y_ - F.col("g0"))
    mean = r.agg((F.avg(a) / F.avg(t_)).alias("estimate"), F.avg(t_).alias("share"))
    psi = (a - t_ * F.col("estimate")) / F.col("share")
    return inferred(join_by(r, mean, ()).agg(F.max("estimate").alias("estimate"), F.sqrt(F.var_samp(psi) / n).alias("se"), n.alias("n")), alpha)


def panel_double_ml(df: DataFrame, y: str, d: str, xs: Sequence[str], unit: str, folds: int = 5, binary: bool = False, ridge: float = 0.0, alpha: float = 0.05, key: Column | None = None) -> DataFrame:
    """Double machine learning with unit means of the covariates beside them, folds by unit, and errors clustered by unit."""
    own = unit_means(df, xs, unit)
    f = Folds(own, {"y": y, "t": d}, [*xs, *[f"{x}_bar" for x in xs]], unit if key is None else key, folds, keep=[unit])
    e, m = f.fitted(["t", "y"], ridge=ridge)
    r = f.rows.select(F.col(unit).alias("u"), (F.col("t") - (_clip(e, 0.01) if binary else e)).alias("rt"), (F.col("y") - m).alias("ry"))
    theta = r.agg((F.sum(F.col("rt") * F.col("ry")) / F.sum(F.col("rt") ** 2)).alias("estimate"), F.sum(F.col("rt") ** 2).alias("j_"), F.count(F.lit(1)).alias("n"))
    per = join_by(r, theta, ()).groupBy("u").agg(F.sum(F.col("rt") * (F.col("ry") - F.col("estimate") * F.col("rt")) / F.col("j_")).alias("s"), F.max("estimate").alias("estimate"), F.max("n").alias("n"))
    out = per.agg(F.max("estimate").alias("estimate"), F.sqrt(F.sum(F.col("s") ** 2)).alias("se"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_units"))
    return inferred(out, alpha)


def rif_effects(df: DataFrame, y: str, t: str, taus: Sequence[float], xs: Sequence[str] = (), unit: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Q2, and D11 with ``unit``: effects on unconditional quantiles: least squares of the recentred influence function on t and xs (and their unit means).

    The density at a quantile is a Gaussian kernel's, of Silverman's bandwidth
    1.06 min(sd, IQR / 1.34) n^-0.2.  Errors are HC0, or clustered by unit."""
    rows = df.where(number(y).isNotNull() & ~F.isnan(number(y)))
    if unit:
        rows, xs = unit_means(rows, xs, unit), [*xs, *[f"{x}_bar" for x in xs]]
    v = number(y)
    low, high, *at = quantiles(rows, y, [0.25, 0.75, *taus]).first()["q"] or [None] * (2 + len(taus))
    first = rows.agg(F.stddev_samp(v).alias("sd"), F.count(v).alias("n")).first()
    if not first["n"]:
        none = [(float(tau), None, None, None, None, 0) for tau in taus]
        return inferred(df.sparkSession.createDataFrame(none, "tau double, quantile double, density double, estimate double, se double, n long"), alpha)
    width = 1.06 * min(first["sd"], (high - low) / 1.34) * first["n"] ** -0.2
    if not width > 0:
        raise ValueError(f"{y} has no spread")
    kernel = [F.avg(F.exp(-(((v - q) / width) ** 2) / 2)) / (width * float(np.sqrt(2 * np.pi))) for q in at]
    density = rows.agg(*[k.alias(f"f{i}") for i, k in enumerate(kernel)]).first()
    each = F.explode(F.array(*[F.struct(F.lit(float(tau)).alias("tau"), F.lit(float(q)).alias("q"), F.lit(float(f)).alias("f")) for tau, q, f in zip(taus, at, density, strict=True)])).alias("z__")
    wide = rows.select("*", each).select("*", F.col("z__.tau").alias("tau__"), (F.col("z__.q") + (F.col("z__.tau") - F.when(v <= F.col("z__.q"), 1.0).otherwise(0.0)) / F.col("z__.f")).alias("rif__"))
    fit = LeastSquares(wide, "rif__", [t, *xs], ["tau__"], robust=None if unit else "HC0", cluster=unit)
    out = fit.coefficient(1, alpha, "clusters").drop("r2", "df")
    known = df.sparkSession.createDataFrame([(float(tau), float(q), float(f)) for tau, q, f in zip(taus, at, density, strict=True)], "tau double, quantile double, density double")
    return known.join(out.withColumnRenamed("tau__", "tau"), "tau")


def q_learning(df: DataFrame, stages: Sequence[tuple[str, Sequence[str]]], y: str, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Backward induction over stages (treatment, history) with linear models of the outcome on history, treatment and their products.

    Returns a row per stage and blip coefficient with HC0 errors, and the value of
    treating wherever the blip is above 0: the mean of the first stage's best outcome
    with its error."""
    own, table = df.withColumn("future__", number(y)), None
    names = lambda h: ["treatment", *[f"treatment*{x}" for x in h]]
    for k in range(len(stages) - 1, -1, -1):
        t, h = stages[k]
        fit = LeastSquares(own, "future__", [*h, t, *[number(t) * number(x) for x in h]], robust="HC0")
        for i, term in enumerate(names(h)):
            one = fit.coefficient(1 + len(h) + i, alpha).drop("r2", "df").withColumns({"stage": F.lit(k + 1).cast("long"), "term": F.lit(term)})
            table = one if table is None else table.unionByName(one)
        beta = fit.first()["line"]
        blip, base = _line(beta[1 + len(h) :], h), _line(beta[: 1 + len(h)], h)
        own = own.withColumn("future__", base + F.greatest(blip, F.lit(0.0)))
    value = own.agg(F.avg("future__").alias("estimate"), (F.stddev_pop("future__") / F.sqrt(F.count("future__"))).alias("se"), F.count("future__").alias("n"))
    return table, inferred(value, alpha)


def a_learning(df: DataFrame, y: str, t: str, xs: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """One stage by advantage learning: the outcome less the control arm's prediction, regressed on (t - e)(1, xs), e the logistic propensity: a row per blip coefficient with HC0 errors."""
    model = BinaryModel(df, t, xs)
    base = LeastSquares(df.where(F.col(t) == 0), y, xs).first()["line"]
    own = df.withColumns({"gap__": number(y) - _line(base, xs), "e__": model.probability()})
    d = number(t) - F.col("e__")
    # Moments (t - e)(1, xs)(gap - t (1, xs) psi) = 0: an instrumental regression of the gap on t(1, xs) by (t - e)(1, xs).
    rows = frame(own, {"g": "gap__", "d": d, "t": t, **{f"x{i}": x for i, x in enumerate(xs)}})
    q = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(xs))]]
    k = len(q)
    sums = rows.agg(*[F.sum(F.col("d") * F.col("t") * a * b).alias(f"a{i}_{j}") for i, a in enumerate(q) for j, b in enumerate(q)], *[F.sum(F.col("d") * F.col("g") * a).alias(f"b{i}") for i, a in enumerate(q)], F.count(F.lit(1)).alias("n")).first()
    bread, _ = inverted(np.array(list(sums[: k * k])).reshape(k, k))
    psi = bread @ np.array(list(sums[k * k : k * k + k]))
    e = F.col("d") * (F.col("g") - F.col("t") * sum((float(b) * c for b, c in zip(psi, q, strict=True)), F.lit(0.0)))
    meat = square(cross_products(rows, [e * c for c in q]).first()["xx"], k)
    se = np.sqrt(np.maximum(np.diag(bread @ meat @ bread.T), 0))
    out = [(c, float(b), float(s), sums["n"]) for c, b, s in zip(["treatment", *[f"treatment*{x}" for x in xs]], psi, se, strict=True)]
    return inferred(df.sparkSession.createDataFrame(out, "term string, estimate double, se double, n long"), alpha)


def panel_quantile_gaps(df: DataFrame, y: str, d: str, unit: str, taus: Sequence[float], replicates: int = 100, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Per tau the treated rows' quantile of y less the others', with error and percentile interval from replicates that weight whole units: tau, estimate, se, ci_lower, ci_upper, replicates, n, n_units.

    A unit's weight in a replicate is a Poisson draw of a hash.  Quantiles are exact: of
    each unit the rows below a bracket around the quantile are counted, only those in it
    are dealt to replicates, and a bracket that some replicate's quantile leaves is
    widened; the first is five errors of a share of so many units, 0.05 at most.  Replicates in which an arm has no rows are left out."""
    rows = df.select(F.col(unit).alias("unit"), number(d).alias("arm"), number(y).alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND arm IN (0, 1)")
    n, units, arms = rows.agg(F.count(F.lit(1)), F.count_distinct("unit"), F.count_distinct("arm")).first()
    shape = "tau double, estimate double, se double, ci_lower double, ci_upper double, replicates long, n long, n_units long"
    if arms < 2:
        return df.sparkSession.createDataFrame([(float(t), None, None, None, None, 0, n, units) for t in taus], shape)
    each = F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("b")
    weight = F.when(F.col("b") == 0, 1).otherwise(poisson_weight(seed, "b", "unit"))
    for slack in sorted({min(SLACKS[0], 2.5 / units**0.5), *SLACKS}):
        ends = quantiles(rows, "v", [*[max(t - slack, 0.0) for t in taus], *[min(t + slack, 1.0) for t in taus]], ["arm"])
        both = join_by(rows, each_row(ends, lambda r: r, "arm double, q array<double>"), ["arm"])
        low, high = lambda i: F.col("q")[i], lambda i: F.col("q")[i + len(taus)]
        counts = both.groupBy("unit", "arm").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("v") < low(i)) for i in range(len(taus))]).alias("below"))
        dealt = counts.select("unit", "arm", "n", "below", each).withColumn("w", weight)
        groups = dealt.groupBy("b", "arm").agg(F.sum(F.col("w") * F.col("n")).alias("total"), F.array(*[F.sum(F.col("w") * F.col("below")[i]) for i in range(len(taus))]).alias("below")).where("total > 0").persist(StorageLevel.MEMORY_AND_DISK)  # two rows a replicate
        inside = both.select("unit", "arm", "v", F.explode(F.array(*[F.when(F.col("v").between(low(i), high(i)), i) for i in range(len(taus))])).alias("i")).where("i IS NOT NULL")
        values = inside.groupBy("unit", "arm", "v", "i").agg(F.count(F.lit(1)).alias("n")).select("*", each).withColumn("k", weight * F.col("n"))
        values = values.groupBy("b", "arm", "i", "v").agg(F.sum("k").alias("k")).persist(StorageLevel.MEMORY_AND_DISK)
        found = {(r["b"], r["arm"]): r["q"] for r in weighted_quantiles(groups, values, taus, ["b", "arm"]).collect()}  # two rows a replicate
        wanted = {(r["b"], r["arm"]) for r in groups.select("b", "arm").collect()}
        groups.unpersist()
        values.unpersist()
        if all(k in found and None not in found[k] for k in wanted):
            break
    out = []
    for i, t in enumerate(taus):
        gaps = {b: found[b, 1.0][i] - found[b, 0.0][i] for b in range(replicates + 1) if (b, 0.0) in found and (b, 1.0) in found}
        drawn = np.array([g for b, g in gaps.items() if b])
        spread = (float(drawn.std(ddof=1)), *(float(x) for x in np.quantile(drawn, [alpha / 2, 1 - alpha / 2]))) if len(drawn) > 1 else (None,) * 3
        out.append((float(t), float(gaps[0]), *spread, len(drawn), n, units))
    return df.sparkSession.createDataFrame(out, shape)
