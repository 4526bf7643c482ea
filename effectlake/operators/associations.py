"""Dependence tests, mediation, selection models, sensitivity, and conjugate Bayesian effects."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .moments import LeastSquares, each_row, frame, gram_rows, grouped, inferred, inverted, join_by, left_over, number, solve, square, types
from .propensity import BinaryModel, normal_cdf, normal_density
from .ranks import quantiles, running


def partial_correlations(df: DataFrame, columns: Sequence[str], given: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per segment and pair of columns the correlation, the partial correlation given the others (or given ``given``), Fisher's z of it and its p-value; all from one Gram matrix."""
    names = [*columns, *[c for c in given or () if c not in columns]]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    rows = gram_rows(df, {c: c for c in names}, by)

    def fit(r: dict) -> dict:
        out = {**{c: r[c] for c in by}, "n": r["n"], "xs": []}
        if r["n"] < 2:
            return out
        m = square(r["xx"], len(names) + 1)
        cov = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / r["n"]
        for i, j in pairs:
            rest = [names.index(c) for c in given] if given is not None else [k for k in range(len(names)) if k not in (i, j)]
            p, _ = inverted(cov[np.ix_([i, j, *rest], [i, j, *rest])])
            rho = float(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1])) if p[0, 0] > 0 and p[1, 1] > 0 else None
            spare, z = r["n"] - len(rest) - 3, None
            if rho is not None and spare > 0 and abs(rho) < 1:
                z = float(np.arctanh(rho) * np.sqrt(spare))
            size = np.sqrt(cov[i, i] * cov[j, j])
            out["xs"].append((names[i], names[j], float(cov[i, j] / size) if size > 0 else None, rho, z, None if z is None else stats.two_sided(z, 1.0)))
        return out

    table = each_row(rows, fit, ", ".join([*types(df, by), "n long, xs array<struct<a:string,b:string,correlation:double,partial:double,z:double,p_value:double>>"]))
    return table.select(*by, "n", F.explode("xs").alias("x")).select(*by, "x.*", "n")


def quantile_bins(df: DataFrame, column: str, bins: int = 3) -> DataFrame:
    """Df with <column>_bin: which part between the column's quantiles a row lies in."""
    cuts = quantiles(df, column, [k / bins for k in range(1, bins)]).first()["q"]
    return df.withColumn(f"{column}_bin", sum((F.when(number(column) > float(c), 1).otherwise(0) for c in cuts), F.lit(0)))


def g_squared(df: DataFrame, a: str, b: str, given: Sequence[str] = (), least: int = 5) -> DataFrame:
    """The G statistic of a and b within strata of ``given``, its degrees of freedom and p-value: counts, then margins of counts.  Strata of fewer than ``least`` rows are left out and counted."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b, *given).agg(F.count(F.lit(1)).alias("n"))
    strata = n.groupBy(*given).agg(F.sum("n").alias("ns"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df")) if given else n.agg(F.sum("n").alias("ns"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"))
    rows, columns = n.groupBy(*given, a).agg(F.sum("n").alias("na")), n.groupBy(*given, b).agg(F.sum("n").alias("nb"))
    cells = join_by(join_by(join_by(n, rows, [*given, a]), columns, [*given, b]), strata, given).where(F.col("ns") >= least)
    g = cells.agg(F.coalesce(F.sum(2 * F.col("n") * F.log(F.col("n") * F.col("ns") / (F.col("na") * F.col("nb")))), F.lit(0.0)).alias("g"))
    used = strata.agg(F.coalesce(F.sum(F.when(F.col("ns") >= least, F.col("df"))), F.lit(0)).alias("df"), F.count_if(F.col("ns") < least).alias("n_left_out"))

    def tail(r: dict) -> dict:
        return {**r, "p_value": stats.chi2_tail(r["g"], int(r["df"])) if r["df"] else 1.0}

    return each_row(join_by(g, used, ()), tail, "g double, df long, n_left_out long, p_value double")


def baron_kenny(df: DataFrame, y: str, t: str, m: str, xs: Sequence[str] = (), by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Direct, indirect and total effect with HC3 errors of the regressions, Sobel's error of the indirect effect, the mediated share."""
    rows = frame(df, {"y": y, "t": t, "m": m, **{f"x{i}": x for i, x in enumerate(xs)}}, by)
    names = [f"x{i}" for i in range(len(xs))]
    a = LeastSquares(rows, "m", ["t", *names], by, robust="HC3").coefficient(1).select(*by, F.col("estimate").alias("a"), F.col("se").alias("sa"))
    out = LeastSquares(rows, "y", ["t", "m", *names], by, robust="HC3")
    direct = out.coefficient(1).select(*by, F.col("estimate").alias("direct"), F.col("se").alias("se_direct"), "n")
    b = out.coefficient(2).select(*by, F.col("estimate").alias("b"), F.col("se").alias("sb"))
    both = join_by(join_by(a, direct, by), b, by)
    indirect = F.col("a") * F.col("b")
    sobel = F.sqrt(F.col("a") ** 2 * F.col("sb") ** 2 + F.col("b") ** 2 * F.col("sa") ** 2)
    total = F.col("direct") + indirect
    table = both.select(*by, "direct", "se_direct", indirect.alias("indirect"), sobel.alias("se_indirect"), total.alias("total"), F.when(total != 0, indirect / total).alias("mediated"), "n")
    return inferred(table, alpha, estimate="indirect", se="se_indirect")


def controlled_direct_effect(df: DataFrame, y: str, t: str, m: str, level: float, xs: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """The effect of t with the mediator held at ``level``: t's coefficient where the mediator is centred there and meets t in a product, with HC3 errors."""
    rows = frame(df, {"y": y, "t": t, "m": number(m) - level, **{f"x{i}": x for i, x in enumerate(xs)}})
    fit = LeastSquares(rows, "y", ["t", "m", F.col("t") * F.col("m"), *[f"x{i}" for i in range(len(xs))]], robust="HC3")
    return fit.coefficient(1, alpha)


def mediation_sensitivity(df: DataFrame, y: str, t: str, m: str, rhos: Sequence[float]) -> DataFrame:
    """T4: the indirect effect when the errors of mediator and outcome correlate by rho, a row per rho, and the rho at which it is 0."""
    row = gram_rows(df, {"t": t, "m": m, "y": y}).first()
    q, n = square(row["xx"], 4), row["n"]
    if n < 5:
        raise ValueError("fewer than 5 rows")
    a, inner = solve(q[:3, :3])[0][1], solve(q)[0]
    sy, sm = np.sqrt(left_over(q, range(3), [3])[0, 0] / (n - 3)), np.sqrt(left_over(q, range(2), [2])[0, 0] / (n - 2))
    null = float(inner[2] * sm / sy)
    return df.sparkSession.createDataFrame([(float(r), float(a * (inner[2] - r * sy / sm)), null if -1 <= null <= 1 else None) for r in rhos], "rho double, indirect double, rho_at_zero double")


def signed_ranks(df: DataFrame, difference: Column, by: Sequence[str] = ()) -> DataFrame:
    """The sums that every Rosenbaum bound needs: number of non-zero pairs, T+, sum of ranks and of squared ranks, ties at their mean rank.

    Differences are counted by size, and sizes ranked within ranges."""
    v = df.select(*by, number(difference).alias("d")).where("d IS NOT NULL AND d <> 0").groupBy(*by, F.abs("d").alias("a")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    ranks = running(v, "a", "k", by).select(*by, "k", "up", (F.col("before") + (F.col("k") + 1) / 2).alias("r"))
    return grouped(ranks, by, F.sum("k").alias("n"), F.sum(F.col("up") * F.col("r")).alias("t_plus"), F.sum(F.col("k") * F.col("r")).alias("sum_r"), F.sum(F.col("k") * F.col("r") ** 2).alias("sum_rr"))


def rosenbaum_bounds(sums: DataFrame, gammas: Sequence[float], alpha: float = 0.05) -> DataFrame:
    """Normal deviates of T+ at the most and least favourable assignment for each Gamma, their one-sided p-values, and critical_gamma, the least of the Gammas at which the greater p-value exceeds alpha (null: none does)."""

    def bounds(r: dict) -> dict:
        xs = []
        for g in gammas:
            hi, lo = g / (1 + g), 1 / (1 + g)
            z = [(r["t_plus"] - p * r["sum_r"]) / np.sqrt(p * (1 - p) * r["sum_rr"]) if r["n"] else None for p in (hi, lo)]
            xs.append((float(g), *[None if x is None else float(x) for x in z], *[None if x is None else 1 - stats.normal_cdf(float(x)) for x in z]))
        over = [x[0] for x in xs if x[3] is not None and x[3] > alpha]
        return {**{c: r[c] for c in by}, "xs": xs, "critical_gamma": min(over) if over else None}

    by = [c for c in sums.columns if c not in ("n", "t_plus", "sum_r", "sum_rr")]
    shape = "xs array<struct<gamma:double,z_lower:double,z_upper:double,p_upper:double,p_lower:double>>, critical_gamma double"
    table = each_row(sums, bounds, ", ".join([*types(sums, by), shape]))
    return table.select(*by, F.explode("xs").alias("x"), "critical_gamma").select(*by, "x.*", "critical_gamma")


def e_values(df: DataFrame, estimate: str, kind: str = "rr", lower: str | None = None, upper: str | None = None, baseline: str | None = None) -> DataFrame:
    """Df and e_value, the strength an unseen confounder needs to explain the estimate away; with the interval's ends, e_value_ci, that of the end nearer to no effect (1 where the interval holds it).

    kind: rr (risk, odds and hazard ratios are taken alike), smd (a standardised
    difference d counts as exp(0.91 d)), ate (a risk difference over the ``baseline`` risk)."""

    def ratio(c: str) -> Column:
        v = number(c)
        return {"rr": v, "smd": F.exp(0.91 * v), "ate": (number(baseline) + v) / number(baseline) if baseline else v}[kind]

    def value(rr: Column) -> Column:
        up = F.when(rr < 1, 1 / rr).otherwise(rr)
        return up + F.sqrt(up * (up - 1))

    out = df.withColumn("e_value", value(ratio(estimate)))
    if lower and upper:
        low, high = ratio(lower), ratio(upper)
        out = out.withColumn("e_value_ci", F.when((low <= 1) & (high >= 1), 1.0).when(low > 1, value(low)).otherwise(value(high)))
    return out


def heckman(df: DataFrame, y: str, selected: str, zs: Sequence[str], xs: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """H1, H2: probit of selection on zs, then least squares of y on xs and the inverse Mills ratio over the selected: a row per coefficient (intercept, xs, lambda), with rho and sigma.

    Errors: s2 (X'X)^-1 plus rho^2 s2 (X'X)^-1 Q (X'X)^-1, Q the products weighted by
    the ratio's derivative.  The row of lambda is the test of selection bias."""
    model = BinaryModel(df, selected, zs, link="probit")
    own = df.where(F.col(selected) == 1).withColumn("z__", model.eta())
    own = own.withColumn("mills__", normal_density(F.col("z__")) / F.greatest(normal_cdf(F.col("z__")), F.lit(1e-10)))
    fit = LeastSquares(own, y, [*xs, "mills__"], keep=["z__", "mills__"])
    r, small = fit.first(), fit.small.first()
    k, n, lam = len(xs) + 2, int(r["n"]), float(r["beta"][-1])
    cols = [F.lit(1.0), *[F.col(f"x{i}_") for i in range(k - 1)]]
    delta = F.col("mills__") * (F.col("mills__") + F.col("z__"))
    sums = fit.rows.agg(F.avg(delta).alias("d"), *[F.sum(delta * a * b) for i, a in enumerate(cols) for b in cols[i:]]).first()
    q = square(list(sums)[1:], k)
    sigma = float(np.sqrt(r["rss"] / n + sums["d"] * lam**2))
    rho = lam / sigma if sigma > 0 else 0.0
    inverse = np.array(small["inverse"]).reshape(k, k)
    cov = sigma**2 * (inverse + rho**2 * inverse @ q @ inverse)
    # The solution is in centred columns: the intercept's error is that of the fit at 0.
    means = own.agg(*[F.avg(number(c)) for c in [*xs, "mills__"]]).first()
    to = np.eye(k)
    to[0, 1:] = [-float(m) for m in means]
    se = np.sqrt(np.maximum(np.diag(to @ cov @ to.T), 0))
    rows = [(c, float(b), float(s), max(-1.0, min(1.0, rho)), sigma, n, model.n) for c, b, s in zip(["intercept", *xs, "lambda"], r["beta"], se, strict=True)]
    return inferred(df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, rho double, sigma double, n_selected long, n long"), alpha)


def selection_hazard(df: DataFrame, selected: str, zs: Sequence[str]) -> DataFrame:
    """H2: df and p_selected, hazard: the probit chance of selection and the density over the chance of not being selected."""
    model = BinaryModel(df, selected, zs, link="probit")
    z = model.eta()
    return df.withColumns({"p_selected": normal_cdf(z), "hazard": normal_density(z) / F.greatest(1 - normal_cdf(z), F.lit(1e-10))})


def survivor_bounds(df: DataFrame, y: str, t: str, survived: str, by: Sequence[str] = ()) -> DataFrame:
    """H3: bounds of the effect on those who survive under either treatment, if treatment never costs survival: y of untreated survivors is theirs; treated survivors hold some whom treatment saved, whose outcomes may lie anywhere in the range."""
    own = df.select(*by, number(t).alias("t"), number(survived).alias("s"), number(y).alias("y")).where("t IN (0, 1) AND s IN (0, 1)")
    arm = lambda f, a, c: f(F.when(F.col("t") == a, c))
    seen = F.when(F.col("s") == 1, F.col("y"))
    m = grouped(own, by, *[arm(F.avg, a, F.col("s")).alias(f"p{a}") for a in (0, 1)], *[arm(F.avg, a, seen).alias(f"m{a}") for a in (0, 1)], F.min(seen).alias("lo"), F.max(seen).alias("hi"), F.count(F.lit(1)).alias("n"))
    saved = F.greatest(F.col("p1") - F.col("p0"), F.lit(0.0))
    side = lambda end: F.greatest(F.least((F.col("p1") * F.col("m1") - saved * end) / F.col("p0"), F.col("hi")), F.col("lo"))
    one = lambda end: F.when(saved > 0, side(end)).otherwise(F.col("m1"))
    return m.select(*by, (one(F.col("hi")) - F.col("m0")).alias("lower"), (one(F.col("lo")) - F.col("m0")).alias("upper"), F.col("p0").alias("always_survive"), saved.alias("saved"), "n")


def conjugate_effect(df: DataFrame, y: str, t: str, xs: Sequence[str] = (), prior_mean: float = 0.0, prior_sd: float = 10.0, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """The normal posterior of the effect: the least-squares estimate and a normal prior by their precisions: estimate, se, interval, shrinkage (the prior's part of the precision)."""
    fit = LeastSquares(df, y, [t, *xs], by).coefficient(1).select(*by, F.col("estimate").alias("b"), F.col("se").alias("s"), "n")
    prior, own = 1 / prior_sd**2, 1 / F.col("s") ** 2
    mean = (prior * prior_mean + own * F.col("b")) / (prior + own)
    return inferred(fit.select(*by, mean.alias("estimate"), (1 / F.sqrt(prior + own)).alias("se"), (prior / (prior + own)).alias("shrinkage"), "n"), alpha)


def stratified_propensity(df: DataFrame, t: str, strata: Sequence[str], prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Y2: per stratum the Beta posterior of the chance of treatment: mean, sd, treated, n."""
    m = df.where(F.col(t).isNotNull()).groupBy(*strata).agg(F.sum(number(t)).alias("treated"), F.count(F.lit(1)).alias("n"))
    a, b = F.col("treated") + prior[0], F.col("n") - F.col("treated") + prior[1]
    return m.select(*strata, (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))).alias("sd"), F.col("treated").cast("long").alias("treated"), "n")


def instrument_overlap(df: DataFrame, zs: Sequence[str], xs: Sequence[str], limit: float = 0.99) -> DataFrame:
    """Per instrument the greatest size of its correlation with a covariate, that covariate, and whether it passes the limit; all from one Gram matrix."""
    row = gram_rows(df, {f"c{i}": c for i, c in enumerate([*zs, *xs])}).first()
    k = len(zs) + len(xs)
    m = square(row["xx"], k + 1)
    cov = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / max(row["n"], 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    out = []
    for i, z in enumerate(zs):
        r = [abs(cov[i, len(zs) + j] / (sd[i] * sd[len(zs) + j])) if sd[i] * sd[len(zs) + j] > 0 else 0.0 for j in range(len(xs))]
        best = int(np.argmax(r)) if r else 0
        out.append((z, xs[best] if r else None, float(r[best]) if r else None, bool(r and r[best] > limit), row["n"]))
    return df.sparkSession.createDataFrame(out, "instrument string, covariate string, correlation double, collinear boolean, n long")


def logistic_posterior(df: DataFrame, t: str, xs: Sequence[str], prior_sd: float = 10.0, alpha: float = 0.05) -> DataFrame:
    """A row per coefficient of a logistic model with normal priors of mean 0 on all but the intercept: the posterior's mode, and its error by the curvature there."""
    model = BinaryModel(df, t, xs, ridge=1 / prior_sd**2)
    rows = [(c, float(b), float(np.sqrt(max(v, 0))), model.n, model.converged) for c, b, v in zip(["intercept", *xs], model.beta, np.diag(model.cov), strict=True)]
    return inferred(df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, n long, converged boolean"), alpha)


def polynomial_mte(df: DataFrame, y: str, d: str, zs: Sequence[str], degree: int = 2, trim: float = 0.01, grid: int = 50) -> DataFrame:
    """U, mte, se: the derivative in the propensity of a polynomial of y on it, at ``grid`` points of the support that both arms reach within their ``trim`` quantiles; HC0 errors."""
    scored = df.withColumn("p__", BinaryModel(df, d, zs).probability())
    ends = {r["t"]: r["q"] for r in quantiles(scored.withColumn("t", F.col(d).cast("int")).where("t IN (0, 1)"), "p__", [trim, 1 - trim], ["t"]).collect()}  # a row per arm
    if set(ends) != {0, 1}:
        raise ValueError("both arms need rows")
    low, high = max(ends[0][0], ends[1][0]), min(ends[0][1], ends[1][1])
    if not low < high:
        raise ValueError("the arms' propensities do not overlap")
    fit = LeastSquares(scored.where(F.col("p__").between(low, high)), y, [F.col("p__") ** j for j in range(1, degree + 1)], robust="HC0").first()
    us = np.linspace(low, high, grid)
    slope = np.array([[0.0, *[j * u ** (j - 1) for j in range(1, degree + 1)]] for u in us])
    mte, var = slope @ fit["line"], np.einsum("ij,jk,ik->i", slope, fit["cov"], slope)
    return df.sparkSession.createDataFrame([(float(u), float(m), float(np.sqrt(max(v, 0)))) for u, m, v in zip(us, mte, var, strict=True)], "u double, mte double, se double")


def effects_from_mte(curve: DataFrame, scored: DataFrame, d: str, p: str) -> DataFrame:
    """The mean of the curve (ate), its mean by the share of treated with a propensity above each point (att), and by that of untreated with one below (atu)."""
    points = curve.orderBy("u").collect()  # the grid
    us, mte = np.array([r["u"] for r in points]), np.array([r["mte"] for r in points])
    v, t = number(p), number(d)
    counts = scored.agg(*[F.sum(F.when((t == 1) & (v > float(u)), 1).otherwise(0)).alias(f"a{i}") for i, u in enumerate(us)], *[F.sum(F.when((t == 0) & (v <= float(u)), 1).otherwise(0)).alias(f"b{i}") for i, u in enumerate(us)]).first()
    a, b = np.array(counts[: len(us)], float), np.array(counts[len(us) :], float)
    mean = lambda w: float((w * mte).sum() / w.sum()) if w.sum() > 0 else None
    return curve.sparkSession.createDataFrame([(float(mte.mean()), mean(a), mean(b))], "ate double, att double, atu double")


def complier_mixture(df: DataFrame, y: str, d: str, z: str, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """Compliers, always- and never-takers as a normal mixture of one variance, by expectation-maximisation: cace, share of each, the four means, sd, rounds, converged, n.

    (z, d) cells of takers of one kind are known; in the other two a row is a complier
    with the odds of its densities.  Each round is one aggregate."""
    rows = frame(df, {"y": y, "d": d, "z": z}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        c = F.col
        cell = lambda f, a, b: f(F.when((c("z") == a) & (c("d") == b), c("y")))
        first = rows.agg(*[cell(F.avg, a, b).alias(f"m{a}{b}") for a in (0, 1) for b in (0, 1)], F.avg(F.when(c("z") == 1, c("d"))).alias("d1"), F.avg(F.when(c("z") == 0, c("d"))).alias("d0"), F.stddev_pop("y").alias("sd"), F.count(F.lit(1)).alias("n")).first()
        if not first["n"] or None in (first["m11"], first["m00"], first["d1"], first["d0"]):
            raise ValueError("both assignments need rows of their own treatment")
        pa, pn = min(max(first["d0"], 1e-3), 0.998), min(max(1 - first["d1"], 1e-3), 0.998)
        pc = max(1 - pa - pn, 1e-3)
        ma, mn = first["m01"] if first["m01"] is not None else first["m11"], first["m10"] if first["m10"] is not None else first["m00"]
        m1, m0, sd, done, k = first["m11"], first["m00"], max(first["sd"], 1e-9), False, 0
        while k < rounds and not done:
            like = lambda m: F.exp(-(((c("y") - float(m)) / float(sd)) ** 2) / 2)  # noqa: E731, B023
            odds = lambda m, other, p, q: F.when(float(p) * like(m) + float(q) * like(other) > 0, float(p) * like(m) / (float(p) * like(m) + float(q) * like(other))).otherwise(p / (p + q))
            w1, w0 = odds(m1, ma, pc, pa), odds(m0, mn, pc, pn)  # of being a complier in (1, 1) and in (0, 0)
            one, none = (c("z") == 1) & (c("d") == 1), (c("z") == 0) & (c("d") == 0)
            always = F.when(one, 1 - w1).when((c("z") == 0) & (c("d") == 1), 1.0).otherwise(0.0)
            never = F.when(none, 1 - w0).when((c("z") == 1) & (c("d") == 0), 1.0).otherwise(0.0)
            kinds = {"1": F.when(one, w1).otherwise(0.0), "0": F.when(none, w0).otherwise(0.0), "a": always, "n": never}
            centre = {"1": m1, "0": m0, "a": ma, "n": mn}
            s = rows.agg(*[x for g, w in kinds.items() for x in (F.sum(w).alias(f"w{g}"), F.sum(w * (c("y") - float(centre[g]))).alias(f"y{g}"), F.sum(w * (c("y") - float(centre[g])) ** 2).alias(f"v{g}"))]).first()
            step = {g: s[f"y{g}"] / s[f"w{g}"] if s[f"w{g}"] > 1e-9 else 0.0 for g in kinds}
            n = first["n"]
            sd = max(float(np.sqrt(sum(s[f"v{g}"] - s[f"w{g}"] * step[g] ** 2 for g in kinds) / n)), 1e-9)
            m1, m0, ma, mn = m1 + step["1"], m0 + step["0"], ma + step["a"], mn + step["n"]
            pc, pa, pn = (s["w1"] + s["w0"]) / n, s["wa"] / n, s["wn"] / n
            k, done = k + 1, max(abs(x) for x in step.values()) < tolerance * max(sd, 1.0)
        out = (m1 - m0, pc, pa, pn, m1, m0, ma, mn, sd, k, bool(done), first["n"])
        return df.sparkSession.createDataFrame([out], "cace double, compliers double, always double, never double, mean_1 double, mean_0 double, mean_always double, mean_never double, sd double, rounds long, converged boolean, n long")
    finally:
        rows.unpersist()
