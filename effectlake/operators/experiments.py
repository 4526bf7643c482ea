"""Estimators for experiments and observational data that are aggregates in a few passes, bounds and checks of input."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .moments import LeastSquares, each_row, frame, grouped, inferred, join_by, number, types
from .resampling import poisson_weight
from .ranks import quantiles, running

CLIP = 1e-6
#: Parts that the replicates of Lee bounds sum the outcomes of an arm and stratum by.
RANGES = 512


def input_report(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """V1: for each column what the checks look at: n, n_null, n_not_finite, n_not_binary, least, greatest and spread, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("v")) for c in columns])).alias("x")
    v = F.col("v")
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    own = F.when(fine, v)
    return df.select(*by, each).select(*by, "x.*").groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(v.isNotNull() & ~fine).alias("n_not_finite"), F.count_if(fine & ~v.isin(0.0, 1.0)).alias("n_not_binary"),
        F.min(own).alias("least"), F.max(own).alias("greatest"), F.stddev_pop(own).alias("spread"),
    )


def require(df: DataFrame, finite: Sequence[str] = (), binary: Sequence[str] = (), varied: Sequence[str] = (), within: dict[str, tuple[float, float]] | None = None) -> None:
    """V1: ValueError unless there are rows, ``finite`` columns hold finite numbers, ``binary`` ones 0 and 1 and both, ``varied`` ones more than one value, and others lie within (low, high)."""
    names = list(dict.fromkeys([*finite, *binary, *varied, *(within or {})]))
    found = {r["column"]: r for r in input_report(df, names).collect()}  # a row per column
    if not found:
        raise ValueError("no rows")
    for c in names:
        r = found[c]
        if r["n_null"] or r["n_not_finite"]:
            raise ValueError(f"{c}: {r['n_null']} nulls, {r['n_not_finite']} numbers that are not finite")
        if c in binary and r["n_not_binary"]:
            raise ValueError(f"{c}: {r['n_not_binary']} values other than 0 and 1")
        if c in (*binary, *varied) and not r["least"] < r["greatest"]:
            raise ValueError(f"{c}: all values are {r['least']}")
        if within and c in within and not (within[c][0] <= r["least"] and r["greatest"] <= within[c][1]):
            raise ValueError(f"{c}: values from {r['least']} to {r['greatest']}, not within {within[c]}")


def _arms(*moments: tuple[str, object], y: str = "y", t: str = "t") -> list[Column]:
    return [f(F.when(F.col(t) == a, F.col(y))).alias(f"{name}{a}") for name, f in moments for a in (0, 1)]


_MOMENTS = (("m", F.avg), ("v", F.var_samp), ("n", F.count))


def simple_ate(df: DataFrame, y: str, t: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Difference in means, standard error from the arms' variances, Welch-Satterthwaite degrees of freedom, t interval."""
    m = grouped(frame(df, {"y": y, "t": t}, by), by, *_arms(*_MOMENTS))
    q1, q0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    out = m.select(
        *by, (F.col("m1") - F.col("m0")).alias("estimate"), F.sqrt(q1 + q0).alias("se"),
        F.try_divide((q1 + q0) ** 2, q1**2 / (F.col("n1") - 1) + q0**2 / (F.col("n0") - 1)).alias("df"), F.col("n1").alias("n_treated"), F.col("n0").alias("n_control"),
    )
    return inferred(out, alpha, "df")


def stratified_ate(df: DataFrame, y: str, t: str, strata: str, by: Sequence[str] = (), alpha: float = 0.05, strict: bool = False) -> DataFrame:
    """R2: strata's differences in means weighted by size.  An arm of one row takes the variance of its whole stratum.

    Strata with an empty arm have no difference: they are left out and counted in
    n_left_out, or refused where ``strict``."""
    s = frame(df, {"y": y, "t": t}, by, [strata]).groupBy(*by, strata).agg(*_arms(*_MOMENTS), F.var_samp("y").alias("v"), F.count(F.lit(1)).alias("n"))
    var = lambda a: F.when(F.col(f"n{a}") > 1, F.col(f"v{a}")).otherwise(F.col("v")) / F.col(f"n{a}")
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    if strict:
        both = F.when(both, True).otherwise(F.raise_error(F.lit("a stratum has no rows of one arm")))
    s = s.select(*by, both.alias("ok"), "n", (F.col("m1") - F.col("m0")).alias("d"), F.when((F.col("n0") > 0) & (F.col("n1") > 0), var(0) + var(1)).alias("q"))
    ok = lambda c: F.when(F.col("ok"), c)
    total = F.sum(ok(F.col("n")))
    out = grouped(
        s, by, (F.sum(ok(F.col("n") * F.col("d"))) / total).alias("estimate"), (F.sqrt(F.sum(ok(F.col("n") ** 2 * F.col("q")))) / total).alias("se"),
        F.count_if("ok").alias("n_strata"), F.count_if(~F.col("ok")).alias("n_left_out"), total.alias("n"), (F.min(ok(F.col("n"))) - 2).alias("df"),
    )
    return inferred(out, alpha, "df")


def hajek_ate(df: DataFrame, y: str, t: str, p: str | Column, by: Sequence[str] = (), weight: str | Column | None = None, alpha: float = 0.05) -> DataFrame:
    """Inverse-probability weights normalised per arm, times ``weight`` where given; one pass for the means, one for the weighted squared residuals.  t interval below 50 rows, else normal."""
    rows = frame(df, {"y": y, "t": t, "p": p, "w": weight if weight is not None else F.lit(1.0)}, by)
    rows = rows.withColumn("w", F.col("w") * F.when(F.col("t") == 1, 1 / F.col("p")).otherwise(1 / (1 - F.col("p"))))
    own = lambda e, a: F.sum(F.when(F.col("t") == a, e))
    w, y_ = F.col("w"), F.col("y")
    means = grouped(rows, by, F.count(F.lit(1)).alias("n"), *[x for a in (0, 1) for x in (own(w, a).alias(f"w{a}"), own(w * w, a).alias(f"ww{a}"), (own(w * y_, a) / own(w, a)).alias(f"m{a}"))])
    both = join_by(rows, means.select(*by, "m0", "m1"), by)
    e = y_ - F.when(F.col("t") == 1, F.col("m1")).otherwise(F.col("m0"))
    spread = grouped(both, by, *[own(w * w * e * e, a).alias(f"e{a}") for a in (0, 1)])
    out = join_by(means, spread, by).select(
        *by, (F.col("m1") - F.col("m0")).alias("estimate"), F.sqrt(F.col("e1") / F.col("w1") ** 2 + F.col("e0") / F.col("w0") ** 2).alias("se"),
        (F.col("w1") ** 2 / F.col("ww1")).alias("ess_treated"), (F.col("w0") ** 2 / F.col("ww0")).alias("ess_control"), "n", small_df().alias("df"),
    )
    return inferred(out, alpha, "df").drop("df")


def small_df() -> Column:
    """n - 2 degrees of freedom below 50 rows; from there on null, which stands for the normal."""
    return F.when(F.col("n") < 50, F.col("n") - 2).cast("long")


def regression_ate(df: DataFrame, y: str, t: str, xs: Sequence[str], by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Least squares of y on t and covariates with HC3 errors and t interval of n - k degrees of freedom."""
    return LeastSquares(df, y, [t, *xs], by, robust="HC3").coefficient(1, alpha)


def smd_table(df: DataFrame, t: str, xs: Sequence[str], by: Sequence[str] = (), weight: str | Column | None = None) -> DataFrame:
    """Standardised mean difference and variance ratio of each covariate: a row per covariate from one aggregate.

    Without any variance the difference is 0 if the means agree, else 1e6 with its
    sign; the ratio is 1 where neither arm varies and infinite where only the treated do."""
    w = F.lit(1.0) if weight is None else number(weight)
    cols = {c: [F.col(f"{k}{i}") for k in ("a", "b", "s", "r")] for i, c in enumerate(xs)}
    one, none = F.col(t) == 1, F.col(t) == 0
    aggs = []
    for i, c in enumerate(xs):
        v = number(c)
        for k, arm in (("a", one), ("b", none)):
            aggs += [(F.sum(F.when(arm & v.isNotNull(), w * v)) / F.sum(F.when(arm & v.isNotNull(), w))).alias(f"{k}{i}")]
        for k, arm in (("s", one), ("r", none)):
            aggs += [F.var_samp(F.when(arm, v)).alias(f"{k}{i}")]
    m = grouped(df, by, *aggs)
    rows = []
    for c, (m1, m0, v1, v0) in cols.items():
        gap, sd = m1 - m0, F.sqrt((v1 + v0) / 2)
        smd = F.when(sd > 0, gap / sd).when(F.abs(gap) < 1e-10, 0.0).otherwise(F.signum(gap) * 1e6)
        ratio = F.when(v0 > 0, v1 / v0).when(v1 > 0, float("inf")).otherwise(1.0)
        rows.append(F.struct(F.lit(c).alias("covariate"), smd.alias("smd"), ratio.alias("variance_ratio")))
    return m.select(*by, F.explode(F.array(*rows)).alias("x")).select(*by, "x.*")


def _support(df: DataFrame, y: str, t: str, by: Sequence[str], support: tuple[float, float] | None) -> DataFrame:
    rows = frame(df, {"y": y, "t": t}, by)
    low, high = (F.min("y"), F.max("y")) if support is None else (F.max(F.lit(float(support[0]))), F.max(F.lit(float(support[1]))))
    return grouped(rows, by, low.alias("lo"), high.alias("hi"), *_arms(("m", F.avg)), F.avg("t").alias("p"), F.count(F.lit(1)).alias("n"))


def manski_bounds(df: DataFrame, y: str, t: str, by: Sequence[str] = (), support: tuple[float, float] | None = None) -> DataFrame:
    """M1, M2, M4: a row per assumption: bounds without any, under monotone response of either sign, under monotone selection, and under selection with response of either sign.

    The support is that of the data unless given.  Both monotone assumptions
    together bound the effect by 0 and the difference in means, at the side of the
    response's sign."""
    c, zero = F.col, F.lit(0.0)
    p, q = c("p"), 1 - c("p")
    naive, mean = c("m1") - c("m0"), p * c("m1") + q * c("m0")
    one_low, one_high = p * c("m1") + q * c("lo"), p * c("m1") + q * c("hi")
    none_low, none_high = q * c("m0") + p * c("lo"), q * c("m0") + p * c("hi")
    kinds = {
        "none": (one_low - none_high, one_high - none_low), "response_up": (zero, one_high - none_low), "response_down": (one_low - none_high, zero),
        "selection": (one_low - none_high, naive), "selection_response_up": (zero, F.greatest(naive, zero)), "selection_response_down": (F.least(naive, zero), zero),
    }
    m = _support(df, y, t, by, support).withColumn("mean", mean)
    rows = [F.struct(F.lit(k).alias("assumption"), lo.alias("lower"), hi.alias("upper"), (hi - lo).alias("width")) for k, (lo, hi) in kinds.items()]
    return m.select(*by, naive.alias("naive"), "n", F.explode(F.array(*rows)).alias("x")).select(*by, "x.*", "naive", "n")


def narrowest_bounds(bounds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M4: the assumptions with the narrowest and the widest bounds, and the bounds that hold under all of them."""
    return grouped(bounds, by, F.min_by("assumption", F.struct("width", "assumption")).alias("narrowest"), F.max_by("assumption", F.struct("width", "assumption")).alias("widest"), F.min("width").alias("least_width"), F.max("width").alias("greatest_width"))


def manski_iv(df: DataFrame, y: str, t: str, z: str, by: Sequence[str] = (), support: tuple[float, float] | None = None) -> DataFrame:
    """M3: the reduced form give or take the outcome's range over the share that doesn't comply, per complier, kept within the range; and the Wald ratio."""
    rows = frame(df, {"y": y, "t": t, "z": z}, by)
    low, high = (F.min("y"), F.max("y")) if support is None else (F.max(F.lit(float(support[0]))), F.max(F.lit(float(support[1]))))
    arm = lambda c, a: F.avg(F.when(F.col("z") == a, F.col(c)))
    m = grouped(rows, by, (high - low).alias("range"), (arm("y", 1) - arm("y", 0)).alias("rf"), (arm("t", 1) - arm("t", 0)).alias("gap"), F.count(F.lit(1)).alias("n"))
    share = F.abs("gap")
    mid, half = F.try_divide(F.col("rf") * F.when(F.col("gap") > 0, 1).otherwise(-1), share), F.try_divide((1 - share) * F.col("range"), share)
    cut = lambda v: F.least(F.greatest(v, -F.col("range")), F.col("range"))
    return m.select(*by, cut(mid - half).alias("lower"), cut(mid + half).alias("upper"), share.alias("complier_share"), F.try_divide("rf", "gap").alias("wald"), "n")


def lee_bounds(df: DataFrame, y: str, t: str, observed: str, by: Sequence[str] = ()) -> DataFrame:
    """M5: the arm with less attrition loses the share of rows, floor(share * n) of them, by which it is observed more often, from either tail.

    Rows are first counted by outcome, and outcomes ranked within ranges, so that no
    task ranks a whole segment."""
    y_, seen = number(y), F.col(observed) == 1
    rows = df.select(*by, F.col(t).cast("int").alias("t"), F.coalesce(seen & y_.isNotNull(), F.lit(False)).alias("seen"), y_.alias("y")).where("t IN (0, 1)")
    own = lambda f, a, c: f(F.when((F.col("t") == a) & F.col("seen"), c))
    arms = grouped(
        rows, by, *[F.avg(F.when(F.col("t") == a, F.col("seen").cast("double"))).alias(f"q{a}") for a in (0, 1)],
        *[own(F.count, a, F.lit(1)).alias(f"n{a}") for a in (0, 1)], *[own(F.avg, a, F.col("y")).alias(f"m{a}") for a in (0, 1)],
    )
    more = F.when(F.col("q1") >= F.col("q0"), 1).otherwise(0)
    share = F.abs(F.col("q1") - F.col("q0")) / F.greatest("q1", "q0")
    arms = arms.select("*", more.alias("arm"), share.alias("share"), F.floor(share * F.when(more == 1, F.col("n1")).otherwise(F.col("n0"))).alias("cut"))
    values = rows.where("seen").groupBy(*by, F.col("t").alias("arm_"), F.col("y").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    ranked = join_by(running(values, "v", "k", [*by, "arm_"]), arms.select(*by, "arm", "cut", F.when(F.col("arm") == 1, F.col("n1")).otherwise(F.col("n0")).alias("n")), by).where("arm_ = arm")
    low = F.greatest(F.lit(0), F.least(F.col("k"), F.col("n") - F.col("cut") - F.col("before")))  # kept when the top goes
    high = F.greatest(F.lit(0), F.least(F.col("k"), F.col("before") + F.col("k") - F.col("cut")))  # kept when the bottom goes
    means = grouped(ranked, by, (F.sum(low * F.col("v")) / F.sum(low)).alias("below"), (F.sum(high * F.col("v")) / F.sum(high)).alias("above"))
    one = F.col("arm") == 1
    return join_by(arms, means, by).select(
        *by, F.when(one, F.col("below") - F.col("m0")).otherwise(F.col("m1") - F.col("above")).alias("lower"),
        F.when(one, F.col("above") - F.col("m0")).otherwise(F.col("m1") - F.col("below")).alias("upper"), F.col("cut").alias("n_trimmed"), "share",
        (F.col("n0") + F.col("n1")).alias("n_observed"),
    )


def _strata(df: DataFrame, x: str, strata: int) -> DataFrame:
    cuts = quantiles(df, x, [k / strata for k in range(1, strata)]).first()["q"]
    stratum = sum((F.when(number(x) >= float(c), 1).otherwise(0) for c in cuts), F.lit(0))
    return df.where(F.col(x).isNotNull()).withColumn("stratum", stratum)


def _by_strata(rows: DataFrame, y: str, t: str, observed: str, least: int, by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, "stratum"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    both = join_by(lee_bounds(rows, y, t, observed, keys), sizes, keys).withColumn("ok", (F.col("size") >= least) & F.col("lower").isNotNull() & F.col("upper").isNotNull())
    w = F.when(F.col("ok"), F.col("size"))
    return grouped(both, by, (F.sum(w * F.col("lower")) / F.sum(w)).alias("lower"), (F.sum(w * F.col("upper")) / F.sum(w)).alias("upper"), F.count_if("ok").alias("n_strata"), F.count_if(~F.col("ok")).alias("n_left_out"))


def lee_bounds_tightened(df: DataFrame, y: str, t: str, observed: str, x: str, strata: int = 5, least: int = 10) -> DataFrame:
    """M6: Lee bounds within strata cut at the quantiles of x, weighted by size; strata of fewer than ``least`` rows are left out and counted."""
    return _by_strata(_strata(df, x, strata), y, t, observed, least)


def lee_intervals(df: DataFrame, y: str, t: str, observed: str, key: str, replicates: int = 100, x: str | None = None, strata: int = 5, least: int = 10, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """M5, M6: the bounds, within strata of x where given, with the interval from the alpha / 2 quantile of the lower to the 1 - alpha / 2 quantile of the upper over replicates: lower, upper, se_lower, se_upper, ci_lower, ci_upper, replicates.

    A row is in a replicate as often as a Poisson draw of a hash of its key.  Outcomes are
    cut into RANGES per stratum and arm, the same for all replicates, whose sums a pass
    brings; only the ranges that the trimming cuts through, two a replicate and stratum,
    are then ordered by value.  Strata are cut once, at the quantiles of all rows."""
    own = df.select(y, t, observed, F.col(key).alias("key__"), *([x] if x and x not in (y, t, observed) else []))
    own = _strata(own, x, strata) if x else own.withColumn("stratum", F.lit(0))
    y_, arm, seen = number(y), F.col(t).cast("int"), F.coalesce((F.col(observed) == 1) & number(y).isNotNull(), F.lit(False))
    own = own.select("key__", "stratum", F.when(arm.isin(0, 1), arm).otherwise(-1).alias("t"), F.when(seen, y_).alias("y"))
    ends = own.where("y IS NOT NULL").groupBy("stratum", "t").agg(F.percentile_approx("y", [k / RANGES for k in range(1, RANGES)], 4 * RANGES).alias("ends_"))
    ends = each_row(ends, lambda r: r, "stratum int, t int, ends_ array<double>")
    own = own.repartition(4 * own.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(ends), ["stratum", "t"], "left").withColumn("range_", F.when(F.col("y").isNotNull(), F.size(F.filter("ends_", lambda e: e < F.col("y")))).otherwise(-1)).drop("ends_")
    own = own.persist(StorageLevel.MEMORY_AND_DISK)
    each = own.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("w", F.when(F.col("b") == 0, 1).otherwise(poisson_weight(seed, "b", "key__"))).where("w > 0")
    keys = ["b", "stratum"]
    parts = each.groupBy(*keys, "t", "range_").agg(F.sum("w").alias("k"), F.sum(F.col("w") * F.col("y")).alias("s")).persist(StorageLevel.MEMORY_AND_DISK)  # ranges x arms x strata x replicates at most
    try:
        of = lambda a, c, f: F.sum(F.when((F.col("t") == a) & f, F.col(c)))
        observed_, any_ = F.col("range_") >= 0, F.lit(True)
        arms = parts.groupBy(*keys).agg(F.sum("k").alias("size"), *[x_.alias(f"{c}{a}") for a in (0, 1) for c, x_ in (("all", of(a, "k", any_)), ("n", of(a, "k", observed_)), ("s", of(a, "s", observed_)))]).collect()  # a row per replicate and stratum
        cells, known = [], {}
        for r in arms:
            if not r.n0 or not r.n1:
                continue
            q0, q1 = r.n0 / r.all0, r.n1 / r.all1
            one = q1 >= q0
            n = r.n1 if one else r.n0
            cut = math.floor(abs(q1 - q0) / max(q0, q1) * n)
            known[r.b, r.stratum] = (one, r.s0 / r.n0, r.s1 / r.n1, r.size)
            cells.append((r.b, r.stratum, int(one), n - cut, cut))
        cells = F.broadcast(df.sparkSession.createDataFrame(cells, "b int, stratum int, t int, top_ long, cut_ long"))
        whole = Window.partitionBy(*keys, "t").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
        placed = parts.where(observed_).withColumn("before", F.coalesce(F.sum("k").over(whole), F.lit(0))).join(cells, [*keys, "t"])
        last = F.col("before") + F.col("k")
        through = ((F.col("before") < F.col("top_")) & (last > F.col("top_"))) | ((F.col("before") < F.col("cut_")) & (last > F.col("cut_")))
        cutting = F.broadcast(placed.where(through).select(*keys, "t", "range_", F.col("before").alias("lower_"), "top_", "cut_"))
        values = each.join(cutting, [*keys, "t", "range_"]).groupBy(*keys, "range_", "y").agg(F.sum("w").alias("k"), *[F.any_value(c).alias(c) for c in ("lower_", "top_", "cut_")])
        inner = Window.partitionBy(*keys, "range_").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
        values = values.withColumn("before", F.col("lower_") + F.coalesce(F.sum("k").over(inner), F.lit(0))).select(*keys, "k", F.col("y").alias("v"), "before", "top_", "cut_")
        rest = placed.where(~through).select(*keys, "k", (F.col("s") / F.col("k")).alias("v"), "before", "top_", "cut_")
        low = F.greatest(F.lit(0), F.least(F.col("k"), F.col("top_") - F.col("before")))  # kept when the top goes
        high = F.greatest(F.lit(0), F.least(F.col("k"), F.col("before") + F.col("k") - F.col("cut_")))  # kept when the bottom goes
        sums = values.unionByName(rest).groupBy(*keys).agg(F.sum(low * F.col("v")).alias("a"), F.sum(low).alias("na"), F.sum(high * F.col("v")).alias("b_"), F.sum(high).alias("nb")).collect()  # a row per replicate and stratum
        drawn: dict[int, list[tuple[float, float, int]]] = {}
        for r in sums:
            one, m0, m1, size = known[r.b, r.stratum]
            if r.na and r.nb and (not x or size >= least):
                below, above = r.a / r.na, r.b_ / r.nb
                drawn.setdefault(r.b, []).append((below - m0, above - m0, size) if one else (m1 - above, m1 - below, size))
        mean = {b: (np.array([d[:2] for d in each_]).T @ np.array([float(d[2]) for d in each_]) / sum(d[2] for d in each_)).tolist() for b, each_ in drawn.items()}
        first, others = mean.pop(0, [None, None]), np.array(list(mean.values())).reshape(-1, 2)
        se = others.std(0, ddof=1).tolist() if len(others) > 1 else [None, None]
        ends = [float(np.quantile(others[:, 0], alpha / 2)), float(np.quantile(others[:, 1], 1 - alpha / 2))] if len(others) else [None, None]
        return df.sparkSession.createDataFrame([(*first, *se, *ends, len(others))], "lower double, upper double, se_lower double, se_upper double, ci_lower double, ci_upper double, replicates long")
    finally:
        parts.unpersist()
        own.unpersist()


def attrition_test(df: DataFrame, t: str, observed: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """V9: difference in the arms' shares of observed rows, with a pooled normal test."""
    rows = frame(df, {"t": t, "o": observed}, by)
    m = grouped(rows, by, *_arms(("q", F.avg), ("n", F.count), y="o"), F.avg("o").alias("q"))
    se = F.sqrt(F.col("q") * (1 - F.col("q")) * (1 / F.col("n1") + 1 / F.col("n0")))
    return inferred(m.select(*by, (F.col("q1") - F.col("q0")).alias("estimate"), se.alias("se"), F.col("q1").alias("observed_treated"), F.col("q0").alias("observed_control")), alpha)


def quantile_effects(df: DataFrame, y: str, t: str, taus: Sequence[float], by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Q1: differences between the arms' quantiles, with linear interpolation; a row per quantile.

    The error is the asymptotic one, tau (1 - tau) / (n f(q)^2) per arm, f by a
    Gaussian kernel of Silverman's bandwidth in that arm."""
    rows = frame(df, {"y": y, "t": t}, by).withColumn("t", F.col("t").cast("int")).where("t IN (0, 1)")
    arms = quantiles(rows, "y", [*taus, 0.25, 0.75], [*by, "t"])
    spread = rows.groupBy(*by, "t").agg(F.stddev_samp("y").alias("sd"), F.count(F.lit(1)).alias("n"))
    k = len(taus)
    q = F.col("q")
    width = 1.06 * F.least("sd", (q[k + 1] - q[k]) / 1.34) * F.col("n") ** -0.2
    arms = join_by(arms, spread, [*by, "t"]).select(*by, "t", "q", "n", width.alias("h"))
    arms = each_row(arms, lambda r: r, ", ".join([*types(rows, by), "t int, q array<double>, n long, h double"]))  # a row per arm and segment, computed once
    kernel = lambda i: F.avg(F.try_divide(F.exp(-(F.try_divide(F.col("y") - q[i], F.col("h")) ** 2) / 2), F.col("h") * (2 * 3.141592653589793) ** 0.5))
    dense = join_by(rows, arms, [*by, "t"]).groupBy(*by, "t").agg(*[kernel(i).alias(f"f{i}") for i in range(k)])
    per = join_by(arms, dense, [*by, "t"])
    each = per.select(*by, "t", "n", F.explode(F.array(*[F.struct(F.lit(float(tau)).alias("tau"), q[i].alias("q"), F.try_divide(F.lit(tau * (1 - tau)), F.col("n") * F.col(f"f{i}") ** 2).alias("v")) for i, tau in enumerate(taus)])).alias("x"))
    arm = lambda c, a: F.max(F.when(F.col("t") == a, F.col(c)))
    out = each.groupBy(*by, F.col("x.tau").alias("tau")).agg((arm("x.q", 1) - arm("x.q", 0)).alias("qte"), F.sqrt(arm("x.v", 1) + arm("x.v", 0)).alias("se"), F.sum("n").alias("n"))
    return inferred(out, alpha, estimate="qte")


def wald_late(df: DataFrame, y: str, d: str, z: str, by: Sequence[str] = (), xs: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """The Wald ratio with its delta-method error (covariance included), the first stage with its F, and the shares of compliers, always- and never-takers.

    Covariates ``xs``, where given, are first taken out of y and d by least squares (over all segments)."""
    rows = frame(df, {"y": y, "d": d, "z": z, **{f"x{i}_": x for i, x in enumerate(xs)}}, by)
    if xs:
        names = [f"x{i}_" for i in range(len(xs))]
        for c in ("y", "d"):
            beta = LeastSquares(rows, c, names).first()["line"]
            rows = rows.withColumn(f"{c}_res", F.col(c) - sum((float(b) * (F.col(n)) for b, n in zip(beta[1:], names, strict=True)), F.lit(0.0)))
        rows = rows.select(*by, F.col("y_res").alias("y"), F.col("d_res").alias("d"), "z")
    aggs = []
    for a in (0, 1):
        own = lambda c, a=a: F.when(F.col("z") == a, F.col(c))
        aggs += [F.avg(own("y")).alias(f"y{a}"), F.avg(own("d")).alias(f"d{a}"), F.var_samp(own("y")).alias(f"vy{a}"), F.var_samp(own("d")).alias(f"vd{a}"), F.covar_samp(own("y"), own("d")).alias(f"c{a}"), F.count(own("y")).alias(f"n{a}")]
    m = grouped(rows, by, *aggs)
    c = F.col
    itt, first = c("y1") - c("y0"), c("d1") - c("d0")
    late = F.when(first != 0, itt / first)
    part = lambda v: c(f"{v}1") / c("n1") + c(f"{v}0") / c("n0")
    var = (part("vy") - 2 * late * part("c") + late**2 * part("vd")) / first**2
    out = m.select(
        *by, late.alias("late"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"), itt.alias("itt"), first.alias("first_stage"), F.try_divide(first**2, part("vd")).alias("first_stage_f"),
        first.alias("compliers"), c("d0").alias("always"), (1 - c("d1")).alias("never"), (c("n0") + c("n1")).alias("n"),
    )
    return inferred(out, alpha, estimate="late")


def late_bounds(df: DataFrame, y: str, d: str, z: str, by: Sequence[str] = (), defiers: float = 0.1) -> DataFrame:
    """The range of complier effects when up to ``defiers`` of all rows defy: the reduced form give or take that share of the outcome's range, over the compliers' share then."""
    rows = frame(df, {"y": y, "d": d, "z": z}, by)
    arm = lambda c, a: F.avg(F.when(F.col("z") == a, F.col(c)))
    m = grouped(rows, by, (F.max("y") - F.min("y")).alias("range"), (arm("y", 1) - arm("y", 0)).alias("itt"), (arm("d", 1) - arm("d", 0)).alias("first"), F.count(F.lit(1)).alias("n"))
    share, slack = F.col("first") + defiers, defiers * F.col("range")
    return m.select(*by, F.try_divide(F.col("itt") - slack, share).alias("lower"), F.try_divide(F.col("itt") + slack, share).alias("upper"), F.try_divide("itt", "first").alias("late"), "n")


def complier_means(df: DataFrame, y: str, d: str, z: str, p: str | Column, xs: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Means of the compliers' outcomes with and without treatment, and of covariates, by kappa weights; p is the chance of z = 1."""
    rows = frame(df, {"y": y, "d": d, "z": z, "p": p, **{f"x{i}": x for i, x in enumerate(xs)}}, by)
    c = F.col
    k1 = c("d") * (c("z") - c("p")) / (c("p") * (1 - c("p")))
    k0 = (1 - c("d")) * ((1 - c("z")) - (1 - c("p"))) / (c("p") * (1 - c("p")))
    k = 1 - c("d") * (1 - c("z")) / (1 - c("p")) - (1 - c("d")) * c("z") / c("p")
    mean = lambda w, v: F.sum(w * v) / F.sum(w)
    return grouped(rows, by, F.avg(k).alias("compliers"), mean(k1, c("y")).alias("y1"), mean(k0, c("y")).alias("y0"), *[mean(k, c(f"x{i}")).alias(f"mean_{x}") for i, x in enumerate(xs)], F.count(F.lit(1)).alias("n"))


def doubly_robust(df: DataFrame, y: str, t: str, p: Column, mu0: Column, mu1: Column, by: Sequence[str] = (), alpha: float = 0.05, clip: float = CLIP) -> DataFrame:
    """The AIPW mean and its influence-function error from fitted columns, the propensity clipped; t interval below 50 rows, else normal."""
    rows = frame(df, {"y": y, "t": t, "p": p, "mu0": mu0, "mu1": mu1}, by)
    p, t_, y_ = F.least(F.greatest(F.col("p"), F.lit(clip)), F.lit(1 - clip)), F.col("t"), F.col("y")
    psi = F.col("mu1") - F.col("mu0") + t_ * (y_ - F.col("mu1")) / p - (1 - t_) * (y_ - F.col("mu0")) / (1 - p)
    outside = (F.col("p") < clip) | (F.col("p") > 1 - clip)
    m = grouped(rows.select(*by, psi.alias("psi"), outside.alias("out")), by, F.avg("psi").alias("estimate"), (F.stddev_pop("psi") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("n"), F.count_if("out").alias("n_clipped"))
    return inferred(m.withColumn("df", small_df()), alpha, "df").drop("df")
