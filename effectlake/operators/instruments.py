"""Instrumental variables, each from a few passes of cross-products.

Columns of the Gram matrix are, in order: intercept, controls, instruments, the
endogenous regressor, the outcome, all centred.  Rows never leave Spark; the k x k
systems are solved per segment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import stats
from .moments import LeastSquares, centred, centred_products, cross_products, each_row, frame, gram_rows, inferred, inverted, join_by, left_over, number, square, types

#: Critical values of the first-stage F at a maximal size of 10 %, one endogenous regressor, by number of instruments (Stock and Yogo 2005).
STOCK_YOGO = {1: 16.38, 2: 19.93, 3: 22.30, 4: 24.58, 5: 26.87}


def _columns(y: str | Column, d: str | Column, zs: Sequence[str], xs: Sequence[str]) -> dict[str, str | Column]:
    return {**{f"x{i}_": x for i, x in enumerate(xs)}, **{f"z{i}_": z for i, z in enumerate(zs)}, "d_": d, "y_": y}


def _solved(df: DataFrame, y: str | Column, d: str | Column, zs: Sequence[str], xs: Sequence[str], by: Sequence[str], f: Callable[[np.ndarray, int], dict], schema: str) -> DataFrame:
    """f of the Gram matrix and the number of rows, per segment; without enough rows its columns are null."""
    columns, least = _columns(y, d, zs, xs), len(xs) + len(zs) + 3
    names = StructType.fromDDL(schema).names

    def run(r: dict) -> dict:
        base = {**{c: r[c] for c in by}, **dict.fromkeys(names), "n": r["n"]}
        return base if r["n"] < least else {**base, **f(square(r["xx"], len(columns) + 1), r["n"])}

    return each_row(gram_rows(df, columns, by), run, ", ".join([*types(df, by), schema, "n long"]))


def _partial_f(m: np.ndarray, n: int, p: int, q: int) -> float:
    rss, rss0 = left_over(m, range(p + q), [p + q])[0, 0], left_over(m, range(p), [p + q])[0, 0]
    return float((rss0 - rss) / q / (rss / (n - p - q))) if rss > 0 else float("inf")


def tsls(
    df: DataFrame, y: str, d: str | Column, zs: Sequence[str | Column], xs: Sequence[str] = (), by: Sequence[str] = (), errors: str = "standard", cluster: str | None = None,
    structural: bool = False, alpha: float = 0.05,
) -> DataFrame:
    """Two-stage least squares: estimate, se, first_stage_f and first_stage_r2 of the instruments, n, df, p_value, interval.

    errors: standard, HC0, HC1 or cluster (with the factors G/(G-1) and (n-1)/(n-k)).
    Residuals are those of the second stage, y less the fitted regressors' part;
    ``structural`` takes those of the regressor itself."""
    if not zs:
        raise ValueError("no instruments")
    p, q = 1 + len(xs), len(zs)
    columns = _columns(y, d, zs, xs)
    rows = frame(df, columns, by, [cluster] if cluster else [])
    k = p + 1

    def fit(r: dict) -> dict:
        n = r["n"]
        base = {**{c: r[c] for c in by}, "n": n, "at": None, "beta": None, "pi": None, "inverse": None, "ss": None, "f": None, "r2": None}
        if n <= p + q + 1:
            return base
        m = square(r["xx"], p + q + 2)
        w, _ = inverted(m[: p + q, : p + q])
        pi = w @ m[: p + q, p + q]
        to = np.zeros((p + q, k))  # regressors of the second stage from the exogenous columns
        to[:p, :p] = np.eye(p)
        to[:, p] = pi
        inverse, known = inverted(to.T @ m[: p + q, : p + q] @ to)
        if not known[-1]:
            return base
        beta = inverse @ to.T @ m[: p + q, -1]
        own = [*range(p), p + q]
        c = np.append(-beta, 1.0)
        full = m[np.ix_([*own, p + q + 1], [*own, p + q + 1])]
        ss = float(c @ full @ c) if structural else float(m[-1, -1] - beta @ to.T @ m[: p + q, -1])
        return {
            **base, "at": list(r["at"]), "beta": beta.tolist(), "pi": pi.tolist(), "inverse": inverse.ravel().tolist(), "ss": max(ss, 0.0), "f": _partial_f(m, n, p, q),
            "r2": float(1 - left_over(m, range(p + q), [p + q])[0, 0] / left_over(m, [0], [p + q])[0, 0]),
        }

    arrays = "n long, at array<double>, beta array<double>, pi array<double>, inverse array<double>, ss double, f double, r2 double"
    small = each_row(centred_products(rows, list(columns), by), fit, ", ".join([*types(df, by), arrays]))
    if errors != "standard":
        both = join_by(rows, small.select(*by, "beta", "pi", "at"), by)
        own = {c: F.col(c) - F.col("at")[i] for i, c in enumerate(columns)}
        cols = [F.lit(1.0), *own.values()]
        fitted = sum((F.col("pi")[i] * c for i, c in enumerate(cols[: p + q])), F.lit(0.0))
        used = [*cols[:p], own["d_"] if structural else fitted]
        e = own["y_"] - sum((F.col("beta")[i] * c for i, c in enumerate(used)), F.lit(0.0))
        scores = both.select(*by, *([F.col(cluster).alias("c_")] if cluster else []), *[(e * c).alias(f"s{i}") for i, c in enumerate([*cols[:p], fitted])])
        if errors == "cluster":
            scores = scores.groupBy(*by, "c_").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
        small = join_by(small, cross_products(scores, [F.col(f"s{i}") for i in range(k)], by).withColumnsRenamed({"n": "g", "xx": "meat"}), by)

    def finish(r: dict) -> dict:
        n, base = r["n"], {**{c: r[c] for c in by}, "n": r["n"], "df": r["n"] - k, "first_stage_f": r["f"], "first_stage_r2": r["r2"]}
        if r["beta"] is None:
            return {**base, "estimate": None, "se": None}
        inverse = np.array(r["inverse"]).reshape(k, k)
        if errors == "standard":
            var = inverse[-1, -1] * r["ss"] / (n - k)
        else:
            factor = {"HC0": 1.0, "HC1": n / (n - k), "cluster": r["g"] / (r["g"] - 1) * (n - 1) / (n - k) if r["g"] > 1 else float("nan")}[errors]
            var = factor * (inverse @ square(r["meat"], k) @ inverse)[-1, -1]
            base["df"] = r["g"] - 1 if errors == "cluster" else n - k
        return {**base, "estimate": float(r["beta"][-1]), "se": float(np.sqrt(max(var, 0)))}

    out = each_row(small, finish, ", ".join([*types(df, by), "estimate double, se double, first_stage_f double, first_stage_r2 double, n long, df long"]))
    return inferred(out, alpha, "df")


def iv_stages(df: DataFrame, y: str, d: str, zs: Sequence[str], xs: Sequence[str] = (), by: Sequence[str] = (), robust: str | None = None, alpha: float = 0.05) -> DataFrame:
    """The first stage (d) and the reduced form (y) on controls and instruments: a row per stage and instrument, with the instruments' partial F in the stage."""
    out = None
    for stage, target in (("first", d), ("reduced", y)):
        fit = LeastSquares(df, target, [*xs, *zs], by, robust=robust)
        strength = instrument_strength(df, target, zs, xs, by).select(*by, F.col("f").alias("partial_f"))
        for i, z in enumerate(zs):
            one = fit.coefficient(1 + len(xs) + i, alpha).drop("r2")
            one = join_by(one, strength, by).select(*by, F.lit(stage).alias("stage"), F.lit(z).alias("term"), *[c for c in one.columns if c not in by], "partial_f")
            out = one if out is None else out.unionByName(one)
    return out


def k_class(df: DataFrame, y: str, d: str, zs: Sequence[str], xs: Sequence[str] = (), fuller: float = 0.0, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Limited-information maximum likelihood, with Fuller's constant where given: estimate, se, kappa, n, interval."""
    p, q = 1 + len(xs), len(zs)

    def fit(m: np.ndarray, n: int) -> dict:
        ends, exog = [p + q, p + q + 1], range(p + q)
        kappa = float(np.linalg.eigvals(inverted(left_over(m, exog, ends))[0] @ left_over(m, range(p), ends)).real.min()) - fuller / (n - q - p)
        every = [*range(p), *ends]
        rest, full = left_over(m, exog, every), m[np.ix_(every, every)]
        g = full - kappa * rest
        inverse, known = inverted(g[:-1, :-1])
        if not known[-1]:
            return {"kappa": kappa}
        beta = inverse @ g[:-1, -1]
        c = np.append(-beta, 1.0)
        s2 = c @ full @ c / (n - len(beta))
        # The fitted part of d beside the controls, which is what d's own variance rests on.
        own = left_over(full - rest, range(p), [p])[0, 0]
        se = float(np.sqrt(s2 / own)) if own > 0 else None
        return {"estimate": float(beta[-1]), "se": se, "kappa": kappa, "df": n - len(beta)}

    return inferred(_solved(df, y, d, zs, xs, by, fit, "estimate double, se double, kappa double, df long"), alpha, "df")


def gmm(df: DataFrame, y: str, d: str, zs: Sequence[str], xs: Sequence[str] = (), steps: int = 2, alpha: float = 0.05) -> DataFrame:
    """Moments weighted by (Z'Z/n)^-1, or in a second step by the inverse of their variance: estimate, robust se, J (of the instruments' block), its df and p-value, interval."""
    columns = _columns(y, d, zs, xs)
    rows, means = centred(frame(df, columns), list(columns))
    p, q = 1 + len(xs), len(zs)
    cols = [F.lit(1.0), *map(F.col, columns)]
    row = cross_products(rows, cols).first()
    m, n = square(row["xx"], p + q + 2), row["n"]
    exog, reg = [*range(p + q)], [*range(p), p + q]
    zx = cols[: p + q]
    zd, zy = m[np.ix_(exog, reg)] / n, m[exog, -1] / n

    def fit(w: np.ndarray) -> np.ndarray:
        return inverted(zd.T @ w @ zd)[0] @ zd.T @ w @ zy

    def spread(beta: np.ndarray) -> np.ndarray:
        e = F.col("y_") - sum((float(b) * c for b, c in zip(beta, [*zx[:p], F.col("d_")], strict=True)), F.lit(0.0))
        return square(cross_products(rows, zx, weight=e * e).first()["xx"], p + q) / n

    w, _ = inverted(m[np.ix_(exog, exog)] / n)
    beta = fit(w)
    if steps > 1:
        w, _ = inverted(spread(beta))
        beta = fit(w)
    bread, _ = inverted(zd.T @ w @ zd)
    cov = bread @ zd.T @ w @ spread(beta) @ w @ zd @ bread / n
    g = zy - zd @ beta
    g = g[p:] + g[0] * np.array([means[f"z{i}_"] for i in range(q)])  # of the instruments as they are
    j = float(n * g @ w[p:, p:] @ g) if q > 1 else 0.0
    out = (float(beta[-1]), float(np.sqrt(cov[-1, -1])), j, q - 1, stats.chi2_tail(j, q - 1) if q > 1 else 1.0, n)
    return inferred(df.sparkSession.createDataFrame([out], "estimate double, se double, j double, j_df long, j_p double, n long"), alpha)


def instrument_strength(df: DataFrame, d: str, zs: Sequence[str], xs: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Partial F of the instruments (with one endogenous regressor the least eigenvalue statistic is the same), the critical value for their number, and a class: strong above it (above 20 where there is none), weak above 10, very_weak."""
    p, q = 1 + len(xs), len(zs)
    critical = STOCK_YOGO.get(q)

    def fit(m: np.ndarray, n: int) -> dict:
        f = _partial_f(m, n, p, q)
        return {"f": f, "critical": critical, "strength": "strong" if f > (critical or 20.0) else "weak" if f > 10 else "very_weak", "n_instruments": q}

    return _solved(df, d, d, zs, xs, by, fit, "f double, critical double, strength string, n_instruments long")


def anderson_rubin(df: DataFrame, y: str, d: str, zs: Sequence[str], xs: Sequence[str] = (), alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """The test of no effect and the set of effects it accepts.

    Intercept and controls are partialled out of everything.  The statistic is
    (y - bd)' P (y - bd) / (q s2), s2 from the reduced form, and is held against
    the chi-squared quantile of q; being quadratic in b, its bounds are exact.
    Infinite bounds stand for a set that is not an interval."""
    p, q = 1 + len(xs), len(zs)

    def fit(m: np.ndarray, n: int) -> dict:
        ends, exog = [p + q, p + q + 1], range(p + q)
        rest = left_over(m, exog, ends)
        part = left_over(m, range(p), ends) - rest
        s2 = rest[1, 1] / (n - p - q)
        stat = float(part[1, 1] / q / s2)
        limit = stats.chi2_quantile(1 - alpha, q) * q * s2
        a, b, c = part[0, 0], -part[0, 1], part[1, 1] - limit
        root = b * b - a * c
        low, high = ((-b - root**0.5) / a, (-b + root**0.5) / a) if root >= 0 and a > 0 else (float("nan"), float("nan"))
        if c < 0 and a <= 0:
            low, high = float("-inf"), float("inf")
        return {"statistic": stat, "p_value": stats.chi2_tail(stat, q), "lower": float(low), "upper": float(high)}

    return _solved(df, y, d, zs, xs, by, fit, "statistic double, p_value double, lower double, upper double")


def conditional_likelihood_ratio(df: DataFrame, y: str, d: str, zs: Sequence[str], xs: Sequence[str] = (), beta0: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """I8: the likelihood-ratio test of d's effect being beta0 given the instruments' strength: lr, q_t (the strength), p_value.

    With errors' covariance from the reduced form, S and T are the instruments'
    parts of y - beta0 d and of what is independent of it; the p-value integrates
    the chi-squared law over the angle between them."""
    p, q = 1 + len(xs), len(zs)

    def fit(m: np.ndarray, n: int) -> dict:
        ends, exog = [p + q + 1, p + q], range(p + q)  # y, d
        rest = left_over(m, exog, ends)
        part = left_over(m, range(p), ends) - rest
        omega = rest / (n - p - q)
        b, a = np.array([1.0, -beta0]), np.array([beta0, 1.0])
        inv, _ = inverted(omega)
        qs = float(b @ part @ b / (b @ omega @ b))
        at = inv @ a
        qt = float(at @ part @ at / (a @ inv @ a))
        qst = float(b @ part @ at / np.sqrt((b @ omega @ b) * (a @ inv @ a)))
        lr = 0.5 * (qs - qt + np.sqrt(max((qs + qt) ** 2 - 4 * (qs * qt - qst**2), 0)))
        return {"lr": float(lr), "q_t": qt, "p_value": clr_tail(lr, qt, q)}

    return _solved(df, y, d, zs, xs, by, fit, "lr double, q_t double, p_value double")


def clr_tail(lr: float, qt: float, q: int) -> float:
    """P(LR > lr given q_t) under the null: the chi-squared law of q degrees of freedom over the squared cosine between S and T."""
    if q == 1:
        return stats.chi2_tail(lr, 1)
    s = (np.arange(2000) + 0.5) / 2000  # the cosine is t in (-1, 1) with density proportional to (1 - t^2)^((q - 3) / 2); by t = sin u it is cos(u)^(q - 2)
    u = (s - 0.5) * np.pi
    density = np.cos(u) ** (q - 2)
    tails = np.array([stats.chi2_tail((qt + lr) / (1 + qt * np.sin(x) ** 2 / lr), q) if lr > 0 else 1.0 for x in u])
    return float((density * tails).sum() / density.sum())


def control_function(df: DataFrame, y: str, d: str, zs: Sequence[str], xs: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Least squares of y on d, controls and the first stage's residual: estimate, se, rho (the residual's coefficient), its se, and p_rho, the test that d is exogenous.

    se counts the first stage's noise: to HC0 it adds rho^2 times the variance that
    estimating the residual gives."""
    first = LeastSquares(df, d, [*xs, *zs], robust="HC0").first()
    names = [*xs, *zs]
    residual = number(d) - sum((float(b) * number(c) for b, c in zip(first["line"][1:], names, strict=True)), F.lit(float(first["beta"][0])))
    second = LeastSquares(df, y, [*xs, d, residual], robust="HC0")
    r, small = second.first(), second.small.first()
    k, rho = len(xs) + 3, float(r["beta"][-1])
    inverse = np.array(small["inverse"]).reshape(k, k)
    both = frame(df, {**{f"w{i}": c for i, c in enumerate(names)}, **{f"x{i}": x for i, x in enumerate(xs)}, "d": d, "v": residual, "y": y})
    own, means = centred(both, both.columns)
    left = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(xs))], F.col("d"), F.col("v")]
    right = [F.lit(1.0), *[F.col(f"w{i}") for i in range(len(names))]]
    cross = own.agg(*[F.sum(a * b).alias(f"c{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right)]).first()
    g = np.array(list(cross)).reshape(k, len(right))
    to = np.eye(len(right))  # the first stage's coefficients at the means
    to[0, 1:] = [means[f"w{i}"] for i in range(len(names))]
    cov = r["cov"] + rho**2 * inverse @ g @ to @ first["cov"] @ to.T @ g.T @ inverse
    se, se_rho = float(np.sqrt(max(cov[-2, -2], 0))), float(np.sqrt(max(r["cov"][-1, -1], 0)))
    row = (float(r["beta"][-2]), se, rho, se_rho, stats.two_sided(rho, se_rho), r["n"])
    return inferred(df.sparkSession.createDataFrame([row], "estimate double, se double, rho double, rho_se double, p_rho double, n long"), alpha)


def shift_share(shares: DataFrame, shocks: DataFrame, location: str, sector: str) -> DataFrame:
    """Location, instrument (shares times shocks, summed) and share_sum; ``shares`` has location, sector, share, ``shocks`` sector, shock.

    Sectors are few against location-sector pairs, and meet them by their key."""
    both = shares.join(shocks, sector)
    return both.groupBy(location).agg(F.sum(F.col("share") * F.col("shock")).alias("instrument"), F.sum("share").alias("share_sum"))


def shift_share_iv(rows: DataFrame, shares: DataFrame, shocks: DataFrame, y: str, d: str, location: str, sector: str, xs: Sequence[str] = (), cluster: str | None = None, alpha: float = 0.05) -> DataFrame:
    """The effect of d by the shift-share instrument, with structural residuals and HC1 errors, or clustered.  rows: one per location."""
    own = rows.join(shift_share(shares, shocks, location, sector), location)
    return tsls(own, y, d, ["instrument"], xs, errors="cluster" if cluster else "HC1", cluster=cluster, structural=True, alpha=alpha)


def rotemberg_weights(rows: DataFrame, shares: DataFrame, shocks: DataFrame, d: str, location: str, sector: str, xs: Sequence[str] = ()) -> DataFrame:
    """Sector, weight: its shock times the shares' products with d (freed of controls), over the sum of their sizes."""
    own = frame(rows, {"d": d, **{f"x{i}": x for i, x in enumerate(xs)}}, (), [location])
    beta = LeastSquares(own, "d", [f"x{i}" for i in range(len(xs))]).first()["line"]
    left = F.col("d") - sum((float(b) * F.col(f"x{i}") for i, b in enumerate(beta[1:])), F.lit(float(beta[0])))
    raw = shares.join(own.select(location, left.alias("left")), location).groupBy(sector).agg(F.sum(F.col("share") * F.col("left")).alias("s")).join(shocks, sector)
    raw = raw.select(sector, (F.col("shock") * F.col("s")).alias("raw"))
    return join_by(raw, raw.agg(F.sum(F.abs("raw")).alias("all_")), ()).select(sector, (F.col("raw") / F.col("all_")).alias("weight"))


def rotemberg_summary(weights: DataFrame, sector: str, top: int = 5) -> DataFrame:
    """negative_share, herfindahl, n_sectors and the ``top`` sectors by size of weight, with their weights."""
    first = weights.orderBy(F.abs("weight").desc(), sector).limit(top)
    listed = first.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.abs("weight").alias("a"), (F.col(sector)).cast("string").alias("s"), "weight")), asc=False), lambda x: x["s"]).alias("top"))
    total = weights.agg(F.coalesce(F.sum(F.when(F.col("weight") < 0, -F.col("weight"))), F.lit(0.0)).alias("negative_share"), F.sum(F.col("weight") ** 2).alias("herfindahl"), F.count(F.lit(1)).alias("n_sectors"))
    return join_by(total, listed, ()).withColumn("top", F.array_join("top", ","))


def cace(df: DataFrame, y: str, d: str, z: str, xs: Sequence[str] = (), by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """I16: the complier effect by two-stage least squares with structural HC0 errors, and the shares of compliers, always- and never-takers."""
    out = tsls(df, y, d, [z], xs, by, errors="HC0", structural=True, alpha=alpha)
    rows = frame(df, {"d": d, "z": z}, by)
    arm = lambda a: F.avg(F.when(F.col("z") == a, F.col("d")))
    m = (rows.groupBy(*by) if by else rows.groupBy()).agg(arm(1).alias("d1"), arm(0).alias("d0"))
    return join_by(out, m.select(*by, (F.col("d1") - F.col("d0")).alias("compliers"), F.col("d0").alias("always"), (1 - F.col("d1")).alias("never")), by)


def strata_bounds(df: DataFrame, y: str, d: str, z: str, by: Sequence[str] = (), direct_effect: float = 0.0) -> DataFrame:
    """H4: a row per assumption: the complier effect give or take a direct effect of the assignment ("monotone"), the outcome's range alone ("none"), and the reduced form give or take the range over the share that doesn't comply ("instrument")."""
    rows = frame(df, {"y": y, "d": d, "z": z}, by)
    arm = lambda c, a: F.avg(F.when(F.col("z") == a, F.col(c)))
    m = (rows.groupBy(*by) if by else rows.groupBy()).agg((F.max("y") - F.min("y")).alias("range"), (arm("y", 1) - arm("y", 0)).alias("itt"), (arm("d", 1) - arm("d", 0)).alias("share"), F.count(F.lit(1)).alias("n"))
    c = F.col
    late, slack, half = F.try_divide("itt", "share"), F.try_divide(F.lit(float(direct_effect)), F.abs("share")), c("range") * (1 - c("share"))
    kinds = {"monotone": (late - slack, late + slack), "none": (-c("range"), c("range")), "instrument": (c("itt") - half, c("itt") + half)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("assumption"), lo.alias("lower"), hi.alias("upper")) for k, (lo, hi) in kinds.items()])).alias("x")
    return m.select(*by, "n", each).select(*by, "x.*", "n")
