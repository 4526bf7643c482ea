"""Regression discontinuities and kinks, density tests and bunching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .moments import cross_products, each_row, frame, grouped, inferred, inverted, join_by, number, solve, square, types, with_means
from .ranks import quantiles

#: Constants of the optimal bandwidth by kernel (Imbens and Kalyanaraman 2012).
BANDWIDTH_CONSTANT = {"triangular": 3.43754, "rectangular": 5.40554}
#: The constant of the triangular kernel in the variance of a log density, and the factor by which it is enlarged to keep the test's size.
DENSITY_CONSTANT, DENSITY_FACTOR = 0.8727, 15.0
#: The constants of the kink bandwidth by kernel, and the least curvature that it divides by, which a side of under three rows has tenfold.
KINK_CONSTANT, LEAST_CURVATURE = {"triangular": 3.43, "rectangular": 2.70}, 0.01
#: More bins than this are refused by the fits, which take them to the driver.
BINS = 100_000


def _kernel(u: Column, kernel: str) -> Column:
    return F.greatest(1 - F.abs(u), F.lit(0.0)) if kernel == "triangular" else F.when(F.abs(u) <= 1, 1.0).otherwise(0.0)


def local_polynomial(df: DataFrame, ys: dict[str, str | Column], x: str | Column, cutoff: float, bandwidth: float | Column, order: int = 1, kernel: str = "triangular", by: Sequence[str] = ()) -> DataFrame:
    """Kernel-weighted polynomials of each of ``ys`` on each side: by..., n_left, n_right, and per name its jump in each derivative (an array, the level first), its sandwich covariances and sides' levels.

    One pass sums the products, one the squared scores; both sides and all ys share
    them.  A side without enough distinct points gives nulls."""
    k, names = order + 1, list(ys)
    rows = frame(df, {**ys, "r_": number(x) - cutoff}, by)
    h = bandwidth if isinstance(bandwidth, Column) else F.lit(float(bandwidth))
    # Distances are held against the bandwidth, so that powers of them stay near 1.
    rows = rows.withColumn("u_", F.col("r_") / h).withColumn("w_", _kernel(F.col("u_"), kernel)).where("w_ > 0").withColumn("side_", (F.col("r_") >= 0).cast("int")).withColumn("h_", h)
    rows = with_means(rows, names, by)
    rows = rows.withColumns({c: F.col(c) - F.col("at_")[i] for i, c in enumerate(names)})
    powers = [F.lit(1.0), *[F.col("u_") ** i for i in range(1, k)]]
    grams = cross_products(rows, [*powers, *map(F.col, names)], [*by, "side_"], F.col("w_"))
    width = rows.groupBy(*by, "side_").agg(F.max("h_").alias("h_"), F.any_value("at_").alias("at_"))

    def fit(r: dict) -> dict:
        m, out = square(r["xx"], k + len(names)), {**{c: r[c] for c in by}, "side_": r["side_"], "n": r["n"], "h_": r["h_"], "at_": r["at_"]}
        inverse = None
        for j, name in enumerate(names):
            keep = [*range(k), k + j]
            beta, inverse, _ = solve(m[np.ix_(keep, keep)])
            out[f"b_{name}"] = beta.tolist() if r["n"] > k and np.isfinite(beta).all() else None
        return {**out, "inverse": inverse.ravel().tolist()}

    small = each_row(join_by(grams, width, [*by, "side_"]), fit, ", ".join([*types(df, by), "side_ int, n long, h_ double, at_ array<double>", *[f"b_{n} array<double>" for n in names], "inverse array<double>"]))
    both = join_by(rows.drop("at_"), small.drop("n", "inverse", "h_", "at_"), [*by, "side_"])
    e = {n: F.col("w_") * (F.col(n) - sum((F.col(f"b_{n}")[i] * p for i, p in enumerate(powers)), F.lit(0.0))) for n in names}
    scores = both.select(*by, "side_", *[(e[n] * p).alias(f"{n}_s{i}") for n in names for i, p in enumerate(powers)])
    all_ = [F.col(f"{n}_s{i}") for n in names for i in range(k)]
    meats = cross_products(scores, all_, [*by, "side_"]).drop("n").withColumnRenamed("xx", "meat")
    full = join_by(small, meats, [*by, "side_"])
    sides = full.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in full.columns if c not in by])).alias("sides")) if by else full.agg(F.collect_list(F.struct(*full.columns)).alias("sides"))  # two rows

    def finish(r: dict) -> dict:
        found = {s["side_"]: s for s in r["sides"]}
        out = {**{c: r[c] for c in by}, **{f"n_{side}": found[i]["n"] if i in found else 0 for i, side in enumerate(("left", "right"))}}
        whole = len(found) == 2 and all(found[i][f"b_{n}"] is not None and found[i]["meat"] is not None for i in (0, 1) for n in names)
        covs = []
        if whole:
            for i in (0, 1):
                s = found[i]
                inverse = np.kron(np.eye(len(names)), np.array(s["inverse"]).reshape(k, k))
                scale = np.tile([s["h_"] ** -j for j in range(k)], len(names))
                covs.append(inverse @ square(s["meat"], k * len(names)) @ inverse * np.outer(scale, scale))
        out["cov"] = (covs[0] + covs[1]).ravel().tolist() if whole else None
        for j, n in enumerate(names):
            if not whole:
                out |= {f"jump_{n}": None, f"left_{n}": None, f"right_{n}": None}
                continue
            b = [np.array(found[i][f"b_{n}"]) * np.array([found[i]["h_"] ** -j for j in range(k)]) for i in (0, 1)]
            out |= {f"jump_{n}": (b[1] - b[0]).tolist(), f"left_{n}": float(b[0][0] + found[0]["at_"][j]), f"right_{n}": float(b[1][0] + found[0]["at_"][j])}
        return out

    return each_row(sides, finish, ", ".join([*types(df, by), "n_left long, n_right long, cov array<double>", *[f"jump_{n} array<double>, left_{n} double, right_{n} double" for n in names]]))


def sharp_rdd(
    df: DataFrame, y: str | Column, x: str, cutoff: float, bandwidth: float | Column, by: Sequence[str] = (), kernel: str = "triangular", order: int = 1, bias_bandwidth: float | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """K4: the jump at the cutoff of local polynomials (linear by default), HC0 errors, t interval of n_left + n_right - 4 degrees of freedom.

    With ``bias_bandwidth`` the gap between a quadratic and a linear fit of that width
    is taken off, and half the linear fit's error there is added to the error."""
    k = order + 1

    def jump(fit: DataFrame, size: int) -> DataFrame:
        return fit.select(*by, F.col("jump_y")[0].alias("estimate"), F.sqrt(F.col("cov")[0]).alias("se"), "n_left", "n_right", F.lit(size).alias("k_"))

    out = jump(local_polynomial(df, {"y": y}, x, cutoff, bandwidth, order, kernel, by), k)
    if bias_bandwidth is not None:
        line = jump(local_polynomial(df, {"y": y}, x, cutoff, bias_bandwidth, 1, kernel, by), 2).select(*by, F.col("estimate").alias("b1"), F.col("se").alias("s1"))
        curve = jump(local_polynomial(df, {"y": y}, x, cutoff, bias_bandwidth, 2, kernel, by), 3).select(*by, F.col("estimate").alias("b2"))
        both = join_by(join_by(out, line, by), curve, by)
        out = both.select(*by, (F.col("estimate") - (F.col("b2") - F.col("b1"))).alias("estimate"), F.sqrt(F.col("se") ** 2 + (0.5 * F.col("s1")) ** 2).alias("se"), "n_left", "n_right", "k_")
    out = out.withColumn("df", (F.col("n_left") + F.col("n_right") - 2 * F.col("k_")).cast("long")).drop("k_")
    return inferred(out, alpha, "df")


def fuzzy_rdd(df: DataFrame, y: str, d: str, x: str, cutoff: float, bandwidth: float, by: Sequence[str] = (), kernel: str = "triangular", alpha: float = 0.05) -> DataFrame:
    """K5: the jump of y over that of the treatment d; with a slope on each side that is the kernel-weighted instrumental estimate.

    The error is the delta method's over both jumps and their covariance; first_stage_f
    is the squared jump of d over its variance, compliance its size.  The estimate is
    null where the treatment doesn't jump."""
    fit = local_polynomial(df, {"y": y, "d": d}, x, cutoff, bandwidth, 1, kernel, by)
    c, first = F.col("cov"), F.col("jump_d")[0]
    ratio = F.when(F.abs(first) > 1e-12, F.col("jump_y")[0] / first)
    # The 4 x 4 covariance holds y's level at 0, d's at 2.
    var = (c[0] - 2 * ratio * c[2] + ratio**2 * c[10]) / first**2
    out = fit.select(*by, ratio.alias("estimate"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"), first.alias("first_stage"), F.try_divide(first**2, c[10]).alias("first_stage_f"), F.abs(first).alias("compliance"), "n_left", "n_right")
    out = out.withColumn("df", (F.col("n_left") + F.col("n_right") - 4).cast("long"))
    return inferred(out, alpha, "df")


def optimal_bandwidth(df: DataFrame, y: str, x: str, cutoff: float, kernel: str = "triangular", by: Sequence[str] = (), pilot: float = 1.0) -> DataFrame:
    """K1, K2: bandwidth by the curvature of a cubic on each side and the variance of residuals near the cutoff, kept from 0.1 to 2 standard deviations of x; and 1.5 times it for the bias."""
    rows = frame(df, {"y": y, "r": number(x) - cutoff}, by).withColumn("side", (F.col("r") >= 0).cast("int"))
    total = grouped(rows, by, F.stddev_pop("r").alias("sd"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))
    both = join_by(rows, total.select(*by, "sd", "m"), by)
    u = F.col("r") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    cubes = cross_products(both, [F.lit(1.0), u, u**2, u**3, F.col("y") - F.col("m")], [*by, "side"])
    near = both.where(F.abs("r") <= pilot).withColumn("w", F.greatest(1 - F.abs(F.col("r") / pilot), F.lit(0.0)))
    lines = cross_products(near, [F.lit(1.0), F.col("r"), F.col("y") - F.col("m")], [*by, "side"], F.col("w")).withColumnsRenamed({"n": "n_near", "xx": "line"})

    def slopes(r: dict) -> dict:
        m = square(r["line"], 3)
        b = inverted(m[:2, :2])[0] @ m[:2, 2]
        return {**{c: r[c] for c in by}, "side": r["side"], "n_near": r["n_near"], "b0": float(b[0]), "b1": float(b[1])}

    near_fit = each_row(lines, slopes, ", ".join([*types(df, by), "side int, n_near long, b0 double, b1 double"]))
    e = F.col("y") - F.col("m") - F.col("b0") - F.col("b1") * F.col("r")
    spread = join_by(near, near_fit, [*by, "side"]).groupBy(*by, "side").agg(F.when(F.count(F.lit(1)) >= 3, F.var_pop(e)).alias("v"))
    sides = cubes.join(spread, [*by, "side"], "left")
    packed = sides.groupBy(*by).agg(F.collect_list(F.struct("side", "n", "xx", "v")).alias("sides")) if by else sides.agg(F.collect_list(F.struct("side", "n", "xx", "v")).alias("sides"))  # two rows

    def finish(r: dict) -> dict:
        curve, var = [], []
        for s in r["sides"]:
            b = solve(square(s["xx"], 5))[0] if s["n"] > 4 else np.zeros(4)
            curve.append(2 * float(np.nan_to_num(b[2])) / r["sd"] ** 2 if r["sd"] else 0.0)
            var.append(s["n"] * (1.0 if s["v"] is None else s["v"]))
        m2 = sum(curve) / 2
        m2 = m2 if abs(m2) >= 1e-6 else 1e-6
        h = BANDWIDTH_CONSTANT[kernel] * (sum(var) / r["n"] / (r["n"] * m2**2)) ** 0.2 if r["n"] else None
        h = min(max(h, 0.1 * r["sd"]), 2 * r["sd"]) if h is not None else None
        return {**{c: r[c] for c in by}, "bandwidth": h, "bias_bandwidth": None if h is None else 1.5 * h, "n": r["n"]}

    return each_row(join_by(total.drop("m"), packed, by), finish, ", ".join([*types(df, by), "bandwidth double, bias_bandwidth double, n long"]))


def cross_validation_bandwidth(df: DataFrame, y: str, x: str, cutoff: float, bandwidths: Sequence[float], kernel: str = "triangular") -> DataFrame:
    """K3: per bandwidth the mean squared error of leaving each row out of its side's local line at the cutoff: e / (1 - h) by its leverage, so that no row is refitted; ``best`` marks the least."""
    rows = frame(df, {"y": y, "r": number(x) - cutoff}).withColumn("side", (F.col("r") >= 0).cast("int"))
    each = rows.withColumn("h", F.explode(F.lit([float(b) for b in bandwidths]))).withColumn("w", _kernel(F.col("r") / F.col("h"), kernel)).where("w > 0")
    mean = rows.agg(F.avg("y")).first()[0] or 0.0
    each = each.withColumn("y", F.col("y") - mean)
    grams = cross_products(each, [F.lit(1.0), F.col("r"), F.col("y")], ["h", "side"], F.col("w"))

    def fit(r: dict) -> dict | None:
        m = square(r["xx"], 3)
        if r["n"] < 3:
            return None
        inverse, _ = inverted(m[:2, :2])
        b = inverse @ m[:2, 2]
        return {"h": r["h"], "side": r["side"], "b0": float(b[0]), "b1": float(b[1]), "i00": float(inverse[0, 0]), "i01": float(inverse[0, 1]), "i11": float(inverse[1, 1])}

    small = each_row(grams, fit, "h double, side int, b0 double, b1 double, i00 double, i01 double, i11 double")
    both = join_by(each, small, ["h", "side"])
    leverage = F.col("w") * (F.col("i00") + 2 * F.col("i01") * F.col("r") + F.col("i11") * F.col("r") ** 2)
    e = (F.col("y") - F.col("b0") - F.col("b1") * F.col("r")) / (1 - leverage)
    scored = both.where(leverage < 1 - 1e-9).groupBy(F.col("h").alias("bandwidth")).agg(F.avg(e**2).alias("error"), F.count(F.lit(1)).alias("n"))
    best = scored.agg(F.min_by("bandwidth", F.struct("error", "bandwidth")).alias("b_"))
    return join_by(scored, best, ()).select("bandwidth", "error", "n", (F.col("bandwidth") == F.col("b_")).alias("best"))


def covariate_balance(df: DataFrame, covariates: Sequence[str], x: str, cutoff: float, bandwidth: float, alpha: float = 0.05) -> DataFrame:
    """K7: the jump of each covariate, a row each, in the passes of one discontinuity."""
    long_ = df.select(F.col(x).alias("x_"), F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), number(c).alias("v")) for c in covariates])).alias("s")).select("x_", "s.*")
    return sharp_rdd(long_, "v", "x_", cutoff, bandwidth, ["covariate"], alpha=alpha)


def donut_rdd(df: DataFrame, y: str, x: str, cutoff: float, bandwidth: float, holes: Sequence[float], alpha: float = 0.05) -> DataFrame:
    """K8: the jump without the rows nearer to the cutoff than each hole."""
    own = df.withColumn("hole", F.explode(F.lit([float(h) for h in holes]))).where(F.abs(number(x) - cutoff) >= F.col("hole"))
    return sharp_rdd(own, y, x, cutoff, bandwidth, ["hole"], alpha=alpha)


def bandwidth_sensitivity(df: DataFrame, y: str, x: str, cutoff: float, bandwidth: float, factors: Sequence[float] = (0.5, 0.75, 1.0, 1.5, 2.0), kernel: str = "triangular", alpha: float = 0.05) -> DataFrame:
    """K9: the jump at each multiple of a bandwidth; all in the same passes."""
    own = df.withColumn("bandwidth", F.explode(F.lit([float(f * bandwidth) for f in factors]))).where(F.abs(number(x) - cutoff) <= F.col("bandwidth"))
    return sharp_rdd(own, y, x, cutoff, F.col("bandwidth"), ["bandwidth"], kernel, alpha=alpha)


def order_sensitivity(df: DataFrame, y: str, x: str, cutoff: float, bandwidth: float, orders: Sequence[int] = (0, 1, 2, 3), alpha: float = 0.05) -> DataFrame:
    """K9: the jump by local polynomials of each order."""
    out = None
    for order in orders:
        one = sharp_rdd(df, y, x, cutoff, bandwidth, order=order, alpha=alpha).withColumn("polynomial", F.lit(order).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def density_test(df: DataFrame, x: str, cutoff: float, bins: int = 20, bandwidth: float | None = None) -> DataFrame:
    """K6: the log ratio of densities at the cutoff, from a histogram of ``bins`` bins on each side, with kernel-weighted quadratics of the log density: theta, se, p_value, bandwidth, n_left, n_right.

    The default bandwidth is 0.9 min(sd, IQR / 1.34) n^-0.2.  Below 10 rows on a side there is no test: theta, se and p_value are null."""
    rows = frame(df, {"r": number(x) - cutoff})
    seen = rows.agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.stddev_pop("r").alias("sd"), F.count_if(F.col("r") < 0).alias("left"), F.count_if(F.col("r") >= 0).alias("right")).first()
    n = {0: seen["left"], 1: seen["right"]}
    shape = "theta double, se double, p_value double, bandwidth double, n_left long, n_right long"
    if min(n.values()) < 10:
        return df.sparkSession.createDataFrame([(None, None, None, bandwidth, n[0], n[1])], shape)
    if bandwidth is None:
        low, high = quantiles(rows, "r", [0.25, 0.75]).first()["q"]
        bandwidth = 0.9 * min(seen["sd"], (high - low) / 1.34) * (n[0] + n[1]) ** -0.2
    side, ends = (F.col("r") >= 0).cast("int"), {0: (seen["lo"], 0.0), 1: (0.0, seen["hi"])}
    place = F.when(side == 0, (F.col("r") - ends[0][0]) / (-ends[0][0] / bins)).otherwise(F.col("r") / (ends[1][1] / bins if ends[1][1] > 0 else 1.0))
    counts = rows.groupBy(side.alias("side"), F.least(F.floor(place), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * bins rows
    at = {}
    for s in (0, 1):
        width = (ends[s][1] - ends[s][0]) / bins or 1.0
        c = np.zeros(bins)
        for r in counts:
            if r["side"] == s:
                c[r["bin"]] = r["n"]
        centre, logs = ends[s][0] + (np.arange(bins) + 0.5) * width, np.log(c / (width * n[s]) + 1e-10)
        w = np.maximum(1 - np.abs(centre) / bandwidth, 0)
        if not w.any():
            w = np.ones(bins)
        # One weighted fit of the greatest degree, to the second, that the bins within the bandwidth allow: with a single one, or none, a level.
        terms = max(1, min(3, int((np.abs(centre) < bandwidth).sum())))
        powers = (centre / bandwidth)[:, None] ** np.arange(terms)
        at[s] = float(np.linalg.lstsq(w[:, None] * powers, w * logs, rcond=None)[0][0])
    theta = at[1] - at[0]
    se = float(np.sqrt(DENSITY_FACTOR * DENSITY_CONSTANT * (1 / (n[0] * bandwidth) + 1 / (n[1] * bandwidth))))
    return df.sparkSession.createDataFrame([(theta, se, stats.two_sided(theta, se), float(bandwidth), n[0], n[1])], shape)


def sharp_kink(df: DataFrame, y: str, x: str, cutoff: float, bandwidth: float, slope_change: float, order: int = 2, by: Sequence[str] = (), kernel: str = "triangular", alpha: float = 0.05) -> DataFrame:
    """The change of y's slope at the kink over the known change of the policy's slope."""
    fit = local_polynomial(df, {"y": y}, x, cutoff, bandwidth, order, kernel, by)
    at = (order + 1) + 1
    out = fit.select(*by, (F.col("jump_y")[1] / slope_change).alias("estimate"), (F.sqrt(F.col("cov")[at]) / abs(slope_change)).alias("se"), "n_left", "n_right")
    return inferred(out.withColumn("df", (F.col("n_left") + F.col("n_right") - 2 * (order + 1)).cast("long")), alpha, "df")


def fuzzy_kink(df: DataFrame, y: str, d: str, x: str, cutoff: float, bandwidth: float, order: int = 2, by: Sequence[str] = (), kernel: str = "triangular", alpha: float = 0.05) -> DataFrame:
    """The change of y's slope over that of d's, with the delta method's error and the first stage's F."""
    fit = local_polynomial(df, {"y": y, "d": d}, x, cutoff, bandwidth, order, kernel, by)
    k, c, first = order + 1, F.col("cov"), F.col("jump_d")[1]
    size = 2 * k
    ratio = F.when(F.abs(first) > 1e-12, F.col("jump_y")[1] / first)
    yy, yd, dd = c[size + 1], c[size + k + 1], c[(k + 1) * size + k + 1]
    out = fit.select(*by, ratio.alias("estimate"), F.sqrt(F.greatest((yy - 2 * ratio * yd + ratio**2 * dd) / first**2, F.lit(0.0))).alias("se"), first.alias("first_stage"), F.try_divide(first**2, dd).alias("first_stage_f"), "n_left", "n_right")
    return inferred(out.withColumn("df", (F.col("n_left") + F.col("n_right") - 2 * k).cast("long")), alpha, "df")


def kink_covariates(df: DataFrame, covariates: Sequence[str], x: str, cutoff: float, bandwidth: float, order: int = 1, kernel: str = "triangular", alpha: float = 0.05) -> DataFrame:
    """The change of each covariate's slope at the kink, a row each, in the passes of one fit; a valid design changes none."""
    long_ = df.select(F.col(x).alias("x_"), F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), number(c).alias("v")) for c in covariates])).alias("s")).select("x_", "s.*")
    return sharp_kink(long_, "v", "x_", cutoff, bandwidth, 1.0, order, ["covariate"], kernel, alpha)


def kink_density(df: DataFrame, x: str, cutoff: float, bandwidth: float, bins: int = 20, alpha: float = 0.05) -> DataFrame:
    """The change of the density's slope at the kink: estimate, se, p_value, ci_lower, ci_upper, n.

    Rows within the bandwidth are counted in ``bins`` bins on each side, closed below and open above; a line through
    the cutoff that may bend there is fitted to the counts, whose variances are the
    counts themselves.  Densities are shares of the rows within the bandwidth.  Without
    such rows all but n are null."""
    width = bandwidth / bins
    rows = frame(df, {"r": number(x) - cutoff}).where((F.col("r") >= -bandwidth) & (F.col("r") < bandwidth))
    place = F.greatest(F.least(F.floor(F.col("r") / width), F.lit(bins - 1)), F.lit(-bins)).cast("int")
    seen = {r.bin: r.n for r in rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 * bins rows
    counts, centre = np.array([seen.get(b, 0) for b in range(-bins, bins)], float), np.arange(-bins, bins) + 0.5
    n, gap, se = int(counts.sum()), None, None
    if n:
        design = np.column_stack([np.ones(2 * bins), centre, np.maximum(centre, 0)])
        bend = np.linalg.solve(design.T @ design, design.T)[2] / (n * width**2)
        gap, se = float(bend @ counts), float(np.sqrt(bend**2 @ counts))
    return inferred(df.sparkSession.createDataFrame([(gap, se, n)], "estimate double, se double, n long"), alpha)


def kink_checks(df: DataFrame, d: str, covariates: Sequence[str], x: str, cutoff: float, bandwidth: float, bins: int = 20, alpha: float = 0.05) -> DataFrame:
    """All checks of a kink design, a row each: check (``density``, ``first stage`` or a covariate's name), estimate (the change of slope), se, p_value, and passed: the first stage's F reaches 10, any other change is not told from none at ``alpha``."""
    columns = ["estimate", "se", "p_value"]
    first = sharp_kink(df, d, x, cutoff, bandwidth, 1.0, 1, alpha=alpha).select(F.lit("first stage").alias("check"), *columns, ((F.col("estimate") / F.col("se")) ** 2 >= 10).alias("passed"))
    same = (F.col("p_value") >= alpha).alias("passed")
    others = kink_covariates(df, covariates, x, cutoff, bandwidth, alpha=alpha).select(F.col("covariate").alias("check"), *columns, same)
    return first.unionByName(others).unionByName(kink_density(df, x, cutoff, bandwidth, bins, alpha).select(F.lit("density").alias("check"), *columns, same))


def kink_bandwidth(df: DataFrame, y: str, x: str, cutoff: float, method: str = "ik", kernel: str = "triangular", by: Sequence[str] = ()) -> DataFrame:
    """The bandwidth of a kink design: by..., bandwidth, pilot, n.

    ``pilot`` is Silverman's width of a density, 1.06 min(sd, iqr / 1.34) n^(-1/5).
    "rot" widens it to the rate of slopes, by n^(4/45).  "ik" weighs the residuals'
    spread about a quadratic on each side and the density within the pilot against the
    quadratics' curvature.  Both are kept between a twentieth and a half of x's range.
    Under 20 rows "ik" is a quarter of the range, and twice the pilot where a side has
    under five rows within it.  Without rows all but n are null."""
    if method not in ("ik", "rot") or kernel not in KINK_CONSTANT:
        raise ValueError(f"method {method!r} or kernel {kernel!r} is unknown")
    rows = frame(df, {"y": y, "r": number(x) - cutoff}, by)
    whole = grouped(rows, by, F.count(F.lit(1)).alias("n"), F.stddev_pop("r").alias("sd"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg("y").alias("m"))
    n = F.col("n")
    if by:
        whole = join_by(whole, quantiles(rows, "r", (0.25, 0.75), by), by)
    else:
        whole = whole.crossJoin(F.broadcast(quantiles(rows, "r", (0.25, 0.75))))
    pilot = 1.06 * F.least(F.col("sd"), (F.col("q")[1] - F.col("q")[0]) / 1.34) * F.pow(n, F.lit(-0.2))
    whole = whole.select(*by, "n", "sd", "m", (F.col("hi") - F.col("lo")).alias("range"), pilot.alias("pilot"))
    whole = each_row(whole, lambda r: r, ", ".join([*types(rows, by), "n long, sd double, m double, range double, pilot double"]))
    kept = F.least(F.greatest(F.col("h"), F.col("range") / 20), F.col("range") / 2)
    if method == "rot":
        return whole.withColumn("h", F.col("pilot") * F.pow(n, F.lit(4 / 45))).select(*by, F.when(n > 0, kept).alias("bandwidth"), F.when(n > 0, F.col("pilot")).alias("pilot"), "n")
    both = join_by(rows, whole.select(*by, "sd", "m", "pilot"), by).withColumn("side", (F.col("r") >= 0).cast("int"))
    u = F.col("r") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    curves = cross_products(both, [F.lit(1.0), u, u**2, F.col("y") - F.col("m")], [*by, "side"])
    near = both.groupBy(*by, "side").agg(F.count_if(F.abs("r") <= F.col("pilot")).alias("near"))
    sides = join_by(curves, near, [*by, "side"])
    packed = grouped(sides, by, F.collect_list(F.struct("side", "n", "xx", "near")).alias("sides"))  # two rows

    def finish(r: dict) -> dict:
        rows_, pilot_, span = r["n"], r["pilot"], r["range"]
        base = {**{c: r[c] for c in by}, "bandwidth": None, "pilot": pilot_ if rows_ else None, "n": rows_}
        if not rows_:
            return base
        if rows_ < 20:
            return {**base, "bandwidth": span / 4}
        found, curve, spread = {s["side"]: s for s in r["sides"]}, [], []
        if any(i not in found or found[i]["near"] < 5 for i in (0, 1)):
            return {**base, "bandwidth": 2 * pilot_}
        for s in (found[0], found[1]):
            g = square(s["xx"], 4)
            inverse, _ = inverted(g[:-1, :-1])
            b = inverse @ g[:-1, -1]
            curve.append(abs(2 * b[2]) / r["sd"] ** 2)
            spread.append(np.sqrt(max(g[-1, -1] - b @ g[:-1, -1], 0.0) / s["n"]))
        density = (found[0]["near"] + found[1]["near"]) / (2 * pilot_ * rows_)
        h = KINK_CONSTANT[kernel] * np.mean(spread) * (density / max(np.mean(curve), LEAST_CURVATURE) ** 2 / rows_) ** (1 / 9)
        return {**base, "bandwidth": float(np.clip(h, span / 20, span / 2))}

    own = join_by(whole, packed, by) if by else whole.crossJoin(F.broadcast(packed))
    return each_row(own, finish, ", ".join([*types(rows, by), "bandwidth double, pilot double, n long"]))


def kink_cross_validation(df: DataFrame, y: str, x: str, cutoff: float, bandwidths: Sequence[float] | None = None, order: int = 2, kernel: str = "triangular") -> DataFrame:
    """Per bandwidth the mean squared error of foretelling every row, near or far, from its side's local polynomial at the kink without that row: bandwidth, error, n, best (the least error's; of equal ones the least).

    Without ``bandwidths`` ten are tried, evenly from half to twice ``kink_bandwidth``.
    A row is left out by its leverage, so nothing is refitted: a pass sums the products
    of all bandwidths, another the errors.  A side with too few rows under the kernel
    foretells none, and a bandwidth that foretells under half of all rows has a null error."""
    if bandwidths is None:
        h = kink_bandwidth(df, y, x, cutoff, "ik", kernel).first().bandwidth
        bandwidths = [] if h is None else np.linspace(h / 2, 2 * h, 10).tolist()
    shape, k = "bandwidth double, error double, n long, best boolean", order + 1
    rows = frame(df, {"y": y, "r": number(x) - cutoff}).withColumn("side", (F.col("r") >= 0).cast("int"))
    total, mean = rows.agg(F.count(F.lit(1)), F.avg("y")).first()
    tried = sorted({float(b) for b in bandwidths if b > 0})
    if not total or not tried:
        return df.sparkSession.createDataFrame([], shape)
    each = rows.withColumn("y", F.col("y") - mean).withColumn("h", F.explode(F.lit(tried))).withColumn("u", F.col("r") / F.col("h")).withColumn("w", _kernel(F.col("u"), kernel))
    powers = [F.lit(1.0), *[F.col("u") ** i for i in range(1, k)]]
    grams = cross_products(each.where("w > 0"), [*powers, F.col("y")], ["h", "side"], F.col("w"))

    def fit(r: dict) -> dict | None:
        g = square(r["xx"], k + 1)
        inverse, alone = inverted(g[:-1, :-1])
        if r["n"] < k or not alone.all():
            return None
        return {"h": r["h"], "side": r["side"], "near": r["n"], "b": (inverse @ g[:-1, -1]).tolist(), "inverse": inverse.ravel().tolist()}

    both = join_by(each, each_row(grams, fit, "h double, side int, near long, b array<double>, inverse array<double>"), ["h", "side"])
    leverage = F.col("w") * sum((F.col("inverse")[i * k + j] * powers[i] * powers[j] for i in range(k) for j in range(k)), F.lit(0.0))
    e = (F.col("y") - sum((F.col("b")[i] * p for i, p in enumerate(powers)), F.lit(0.0))) / (1 - leverage)
    enough = (F.col("near") - (F.col("w") > 0).cast("int") >= k) & (leverage < 1 - 1e-9)
    scored = {r.h: (r.error, r.n) for r in both.where(enough).groupBy("h").agg(F.avg(e**2).alias("error"), F.count(F.lit(1)).alias("n")).collect()}  # a row per bandwidth
    found = [(h, *scored.get(h, (None, 0))) for h in tried]
    found = [(h, error if n >= total // 2 else None, n) for h, error, n in found]
    best = min((error, h) for h, error, _ in found if error is not None)[1] if any(error is not None for _, error, _ in found) else None
    return df.sparkSession.createDataFrame([(h, error, n, h == best) for h, error, n in found], shape)


def histogram(df: DataFrame, x: str, cutoff: float, width: float) -> DataFrame:
    """B1: counts by bin of ``width`` from the cutoff; the fits need nothing else."""
    rows = frame(df, {"r": number(x) - cutoff})
    return rows.groupBy(F.floor(F.col("r") / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _counterfactual(b: np.ndarray, n: np.ndarray, out: np.ndarray, degree: int) -> np.ndarray:
    degree = min(degree, max(0, int(out.sum()) - 1))
    return np.maximum(np.polynomial.Polynomial.fit(b[out], n[out], degree)(b), 0)


def bunching(
    df: DataFrame, x: str, threshold: float, width: float, window: int, degree: int = 7, within: tuple[int, int] | None = None, rates: tuple[float, float] | None = None, replicates: int = 0,
    seed: int = 0, iterate: bool = False, alpha: float = 0.05,
) -> DataFrame:
    """Excess mass at a threshold over a polynomial fitted to the bins outside the window: excess, height, mass (excess over height), elasticity, se, interval, bins, n_outside, rounds.

    ``within`` limits the bins that count (first, last); rows of others are counted in
    n_outside.  Bins without rows count as 0.  ``rates`` are the tax rates below and
    above, for the elasticity.  ``iterate`` moves the window's upper end by the mass
    until it stays put.  The error comes from ``replicates`` multinomial draws of the
    counts by bin, whose law is that of drawing rows anew.  Bins, not rows, come to the driver."""
    counts = histogram(df, x, threshold, width)
    inside = counts.where(F.col("bin").between(*within)) if within else counts
    found = inside.limit(BINS + 1).collect()
    if len(found) > BINS:
        raise ValueError(f"more than {BINS} bins: state a range or a greater width")
    shape = "excess double, height double, mass double, elasticity double, se double, ci_lower double, ci_upper double, bins long, n_outside long, rounds long"
    left = (counts.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in found)
    if len(found) < 2:
        return df.sparkSession.createDataFrame([(None, None, None, None, None, None, None, len(found), left, 0)], shape)
    first, last = min(r["bin"] for r in found), max(r["bin"] for r in found)
    if last - first >= BINS:
        raise ValueError(f"bins from {first} to {last}: state a range or a greater width")
    b, n = np.arange(first, last + 1, dtype=float), np.zeros(last - first + 1)
    for r in found:
        n[r["bin"] - first] = r["n"]

    def measure(n: np.ndarray) -> tuple[float, float, float, int]:
        upper, rounds, mass, excess, height = float(window), 0, 0.0, 0.0, 0.0
        while True:
            out = (b < -window) | (b >= upper)
            if not out.any() or out.all():
                return float("nan"), float("nan"), float("nan"), rounds
            cf = _counterfactual(b, n, out, degree)
            excess, height = float((n[~out] - cf[~out]).sum()), float(cf[~out].mean())
            mass, rounds = excess / height if height else float("nan"), rounds + 1
            moved = max(float(window), float(np.ceil(mass))) if np.isfinite(mass) else upper
            if not iterate or moved == upper or rounds >= 50:
                return excess, height, mass, rounds
            upper = moved

    excess, height, mass, rounds = measure(n)
    elastic = mass / np.log((1 - rates[0]) / (1 - rates[1])) if rates and rates[0] != rates[1] else None
    se = low = high = None
    if replicates:
        rng = np.random.default_rng(seed)
        drawn = [measure(rng.multinomial(int(n.sum()), n / n.sum()).astype(float))[2] for _ in range(replicates)]
        drawn = np.array([m for m in drawn if np.isfinite(m)])
        if len(drawn) > 1:
            se, low, high = float(drawn.std(ddof=1)), float(np.quantile(drawn, alpha / 2)), float(np.quantile(drawn, 1 - alpha / 2))
    return df.sparkSession.createDataFrame([(excess, height, mass, None if elastic is None else float(elastic), se, low, high, len(b), left, rounds)], shape)
