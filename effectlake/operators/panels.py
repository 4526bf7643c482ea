"""Panels and differences in differences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .moments import LeastSquares, each_row, frame, grouped, inferred, join_by, number, types
from .resampling import draw, percentile_interval, poisson_weight

#: More periods than this are refused by the two-way transform, whose system is periods x periods.
PERIODS = 2_000
#: More cohort-time cells than this are refused by sun_abraham, whose dummies they are.
CELLS = 2_000


def staggered_panel(df: DataFrame, unit: str, time: str, d: str, strict: bool = False) -> DataFrame:
    """IO3: unit, first_treated (null: never) and whether the treatment is ever switched off, which ``strict`` refuses."""
    on = F.col(d) == 1
    out = df.groupBy(unit).agg(F.min(F.when(on, F.col(time))).alias("first_treated"), F.max(F.when(~on, F.col(time))).alias("last_off"))
    out = out.select(unit, "first_treated", F.coalesce(F.col("last_off") > F.col("first_treated"), F.lit(False)).alias("switches_off"))
    if strict:
        out = out.withColumn("switches_off", F.when(F.col("switches_off"), F.raise_error(F.lit("a treatment is switched off")).cast("boolean")).otherwise(False))
    return out


def constant_within(df: DataFrame, column: str, unit: str) -> DataFrame:
    """V2: number of units, and of those in which ``column`` is not constant."""
    per = df.groupBy(unit).agg((F.min(column) != F.max(column)).alias("varies"))
    return per.agg(F.count(F.lit(1)).alias("n_units"), F.count_if("varies").alias("n_varying"))


def did_2x2(df: DataFrame, y: str, t: str, post: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Difference in differences from four cells' means, with the errors of the cells' variances and the normal interval."""
    rows = frame(df, {"y": y, "t": t, "p": post}, by)
    cell = lambda f, a, b: f(F.when((F.col("t") == a) & (F.col("p") == b), F.col("y")))
    ks = [(a, b) for a in (0, 1) for b in (0, 1)]
    m = grouped(rows, by, *[cell(F.avg, a, b).alias(f"m{a}{b}") for a, b in ks], *[(cell(F.var_samp, a, b) / cell(F.count, a, b)).alias(f"q{a}{b}") for a, b in ks], F.count(F.lit(1)).alias("n"))
    est = F.col("m11") - F.col("m10") - F.col("m01") + F.col("m00")
    return inferred(m.select(*by, est.alias("estimate"), F.sqrt(sum((F.col(f"q{a}{b}") for a, b in ks), F.lit(0.0))).alias("se"), "n"), alpha)


def did_regression(df: DataFrame, y: str, t: str, post: str, unit: str | None = None, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """The same estimate from a regression on t, post and their product, with errors clustered by unit and t of clusters less one, or HC3 where there is no unit.

    A unit whose t changes is an error (V2)."""
    if unit and constant_within(df, t, unit).first()["n_varying"]:
        raise ValueError(f"{t} is not constant within {unit}")
    xs = [t, post, number(t) * number(post)]
    fit = LeastSquares(df, y, xs, by, robust=None if unit else "HC3", cluster=unit)
    return fit.coefficient(3, alpha, "clusters")


def two_way(df: DataFrame, columns: Sequence[str], unit: str, time: str) -> tuple[DataFrame, int]:
    """The rows with ``columns`` freed of unit and period effects, exactly, whether or not the panel is balanced; and the number of effects.

    Unit effects go by unit means.  What is left of the period dummies after that is
    a system of periods x periods, from counts per pair of periods that a unit has
    in common: unit dummies are never made, and no pass grows with their number."""
    rows = frame(df, {c: c for c in columns}, (), [unit, time])
    means = rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n_u"), *[F.avg(c).alias(f"{c}_u") for c in columns])
    joined = join_by(rows, means, [unit])
    right = joined.groupBy(time).agg(F.count(F.lit(1)).alias("n_t"), *[F.sum(F.col(c) - F.col(f"{c}_u")).alias(c) for c in columns]).limit(PERIODS + 1).collect()
    if len(right) > PERIODS:
        raise ValueError(f"more than {PERIODS} periods")
    if not right:
        return rows, 0
    cells = rows.groupBy(F.col(unit).alias("u"), F.col(time).alias("p")).agg(F.count(F.lit(1)).alias("k"))
    sizes = cells.groupBy(F.col("u").alias("u__")).agg(F.sum("k").alias("n_u"), F.collect_list(F.struct("p", "k")).alias("all"))  # a unit has PERIODS cells at most
    pairs = sizes.select("n_u", "all", F.explode("all").alias("a")).select("n_u", "a", F.explode("all").alias("b"))
    pairs = pairs.groupBy(F.col("a.p").alias("s"), F.col("b.p").alias("t")).agg(F.sum(F.col("a.k") * F.col("b.k") / F.col("n_u")).alias("v")).collect()
    at = {r[time]: i for i, r in enumerate(right)}
    system = np.diag([float(r["n_t"]) for r in right])
    for r in pairs:
        system[at[r["s"]], at[r["t"]]] -= r["v"]
    effects = np.linalg.pinv(system, rcond=1e-11, hermitian=True) @ np.array([[r[c] for c in columns] for r in right])
    table = df.sparkSession.createDataFrame(
        [(r[time], *map(float, e)) for r, e in zip(right, effects, strict=True)], ", ".join([f"period__ {dict(df.dtypes)[time]}", *[f"e{i}__ double" for i in range(len(columns))]])
    )
    freed = rows.join(F.broadcast(table), F.col(time).eqNullSafe(F.col("period__"))).select(unit, time, *[(F.col(c) - F.col(f"e{i}__")).alias(c) for i, c in enumerate(columns)])
    again = freed.groupBy(unit).agg(*[F.avg(c).alias(f"{c}_u") for c in columns])
    out = join_by(freed, again, [unit]).select(unit, time, *[(F.col(c) - F.col(f"{c}_u")).alias(c) for c in columns])
    return out, means.count() + len(right) - 1


def twfe(df: DataFrame, y: str, d: str, unit: str, time: str, alpha: float = 0.05) -> DataFrame:
    """The coefficient of d beside unit and period effects, with errors clustered by unit; the small-sample factor counts the effects too."""
    rows, effects = two_way(df.select(unit, time, number(y).alias("y"), number(d).alias("d")), ["y", "d"], unit, time)
    return LeastSquares(rows, "y", ["d"], cluster=unit, extra=effects, intercept=False).coefficient(0, alpha, "clusters").drop("r2")


def _dummies(df: DataFrame, y: str, unit: str, time: str, dummies: dict[str, Column]) -> LeastSquares:
    rows = df.select(unit, time, number(y).alias("y"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in dummies.items()])
    freed, effects = two_way(rows, ["y", *dummies], unit, time)
    return LeastSquares(freed, "y", list(dummies), cluster=unit, extra=effects, intercept=False)


def event_study(df: DataFrame, y: str, treated: str, unit: str, time: str, start: int, leads: int, lags: int, omit: int = -1, alpha: float = 0.05) -> DataFrame:
    """D3: a row per period relative to ``start``, from -leads to lags - 1 but ``omit``: the coefficient of its dummy for units that are ever treated, beside unit and period effects, errors clustered by unit.

    pretrend_p is the Wald test, by the chi-squared law, that all leads are 0."""
    ever = df.groupBy(unit).agg(F.max(number(treated)).alias("ever_"))
    own = join_by(df.select(unit, time, y), ever, [unit])
    ks = [k for k in range(-leads, lags) if k != omit]
    fit = _dummies(own, y, unit, time, {f"k{i}": (F.col("ever_") == 1) & (F.col(time) - start == k) for i, k in enumerate(ks)})
    r = fit.first()
    before = [i for i, k in enumerate(ks) if k < 0]
    wald = None
    if before:
        b, v = r["beta"][before], r["cov"][np.ix_(before, before)]
        wald = stats.chi2_tail(float(b @ np.linalg.pinv(v) @ b), len(before)) if np.isfinite(v).all() and np.isfinite(b).all() else None
    rows = [(k, float(b) if np.isfinite(b) else None, float(s) if np.isfinite(s) and np.isfinite(b) else None, int((r["n_clusters"] or 0) - 1), int(r["n"]), wald) for k, b, s in zip(ks, r["beta"], r["se"], strict=True)]
    return inferred(df.sparkSession.createDataFrame(rows, "event_time long, estimate double, se double, df long, n long, pretrend_p double"), alpha, "df")


def sun_abraham(df: DataFrame, y: str, unit: str, time: str, first: str, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Effects per cohort and event time from 0 on, beside unit and period effects, with errors clustered by unit; and their average by shares of treated rows, with the delta-method error.

    first: the period of first treatment, null for never.  More than CELLS cohort-time
    cells are an error: none is left out.  Without treated rows there are no cells, and
    the average is a row of nulls."""
    k = F.col(time) - F.col(first)
    cells = df.where(F.col(first).isNotNull() & (k >= 0)).groupBy(F.col(first).cast("long").alias("g"), k.cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy("g", "k").limit(CELLS + 1).collect()
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} cohort-time cells")
    if not cells:
        none = df.sparkSession.createDataFrame([], "cohort long, event_time long, estimate double, se double, df long, n_treated long")
        total = df.sparkSession.createDataFrame([(None, None, None, df.count(), 0)], "estimate double, se double, df long, n long, n_cells long")
        return inferred(none, alpha, "df"), inferred(total, alpha, "df")
    fit = _dummies(df, y, unit, time, {f"c{i}": (F.col(first) == r["g"]) & (F.col(time) - F.col(first) == r["k"]) for i, r in enumerate(cells)})
    r = fit.first()
    spark, df_ = df.sparkSession, int((r["n_clusters"] or 0) - 1)
    each = [(c["g"], c["k"], float(b) if np.isfinite(b) else None, float(s) if np.isfinite(b) and np.isfinite(s) else None, df_, c["n"]) for c, b, s in zip(cells, r["beta"], r["se"], strict=True)]
    effects = inferred(spark.createDataFrame(each, "cohort long, event_time long, estimate double, se double, df long, n_treated long"), alpha, "df")
    # Cells that the others make up have no effect of their own and no part in the average.
    w = np.array([c["n"] for c in cells], float) * np.isfinite(r["beta"])
    w /= max(w.sum(), 1)
    total = [(float(w @ np.nan_to_num(r["beta"])), float(np.sqrt(max(w @ r["cov"] @ w, 0))), df_, int(r["n"]), int((w > 0).sum()))]
    return effects, inferred(spark.createDataFrame(total, "estimate double, se double, df long, n long, n_cells long"), alpha, "df")


def wild_bootstrap(df: DataFrame, y: str, xs: Sequence[str | Column], i: int, cluster: str, replicates: int, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Error and centred p-value of coefficient i by the wild cluster bootstrap: signs, or below 13 clusters six points, drawn per cluster.

    A draw needs no refit: it moves the coefficient by the drawn sum of each
    cluster's score, one number a cluster; draws are summed by replicate."""
    fit = LeastSquares(df, y, xs, cluster=cluster)
    r, k, small = fit.first(), len(xs) + 1, fit.small.first()
    names = [F.lit(1.0), *[F.col(f"x{j}_") for j in range(k - 1)]]
    row = small["inverse"][i * k : i * k + k]
    e = F.col("y_") - sum((float(b) * c for b, c in zip(small["slope"], names, strict=True)), F.lit(0.0))
    scores = fit.rows.groupBy(F.col(cluster).alias("c")).agg(F.sum(e * sum((float(w) * c for w, c in zip(row, names, strict=True)), F.lit(0.0))).alias("a"))
    u = draw(seed, "b", "c")
    few = r["n_clusters"] < 13
    points = [-1.5**0.5, -1.0, -(0.5**0.5), 0.5**0.5, 1.0, 1.5**0.5]
    sign = F.element_at(F.lit(points), (F.floor(u * 6) + 1).cast("int")) if few else F.when(u < 0.5, -1.0).otherwise(1.0)
    draws = scores.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).groupBy("b").agg(F.sum(sign * F.col("a")).alias("move"))
    b = float(r["beta"][i])
    out = draws.agg(F.lit(b).alias("estimate"), F.stddev_samp("move").alias("se"), F.avg((F.abs("move") >= abs(b)).cast("double")).alias("p_bootstrap"), F.count(F.lit(1)).alias("replicates"), F.lit(int(r["n_clusters"])).cast("long").alias("n_clusters"))
    return inferred(out, alpha)


def parallel_trends(df: DataFrame, y: str, t: str, time: str, unit: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Difference in slope between the arms over the rows of ``df``, the periods before treatment, with errors clustered by unit: estimate, se, p_value (t of clusters less one), interval, n, n_clusters."""
    out = LeastSquares(df, y, [t, time, number(t) * number(time)], by, cluster=unit).coefficient(3, alpha, "clusters")
    return out.withColumn("n_clusters", F.col("df") + 1).drop("r2", "df")


def unit_means(df: DataFrame, columns: Sequence[str], unit: str) -> DataFrame:
    """Df and, per column, its unit's mean as <column>_bar; by partial sums and a join, as a unit may hold any share of the rows."""
    means = df.groupBy(F.col(unit).alias("unit_")).agg(*[F.avg(c).alias(f"{c}_bar") for c in columns])
    return df.join(means, F.col(unit).eqNullSafe(F.col("unit_")), "left").drop("unit_")


def _changes(df: DataFrame, y: str, unit: str, time: str, first: str, controls: str) -> tuple[DataFrame, Column, Column]:
    own = df.select(unit, F.col(time).alias("t"), number(y).alias("y"), F.col(first).alias("g"))
    cohorts = F.broadcast(own.where(F.col("g").isNotNull()).select(F.col("g").alias("cohort")).distinct())
    base = own.join(cohorts, F.col("t") == F.col("cohort") - 1).select(F.col(unit).alias("u_"), "cohort", F.col("y").alias("y0"))
    change = own.join(base, (F.col(unit) == F.col("u_")) & (F.col("t") >= F.col("cohort"))).select(F.col(unit).alias("unit"), "cohort", "t", "g", (F.col("y") - F.col("y0")).alias("dy"))
    never = F.col("g").isNull()
    return change, F.col("g") == F.col("cohort"), never if controls == "never" else never | (F.col("g") > F.col("t"))


def group_time_effects(df: DataFrame, y: str, unit: str, time: str, first: str, controls: str = "not_yet") -> DataFrame:
    """ATT(g, t) for t >= g: the change since period g - 1 of cohort g less that of units not treated by t, or with controls="never" never treated.

    Cohorts, base periods and periods meet as (cohort, time) pairs of a small
    table: per unit only its own changes are joined, keyed by unit."""
    change, treated, control = _changes(df, y, unit, time, first, controls)
    cells = change.groupBy("cohort", "t").agg(F.avg(F.when(treated, F.col("dy"))).alias("a"), F.avg(F.when(control, F.col("dy"))).alias("b"), F.count_if(treated).alias("n_treated"), F.count_if(control).alias("n_control"))
    return cells.where("n_treated > 0 AND n_control > 0").select("cohort", F.col("t").alias("period"), (F.col("a") - F.col("b")).alias("att"), "n_treated", "n_control")


def aggregate_effects(cells: DataFrame, how: str = "dynamic", more: Sequence[str] = ()) -> DataFrame:
    """Averages of group_time_effects weighted by cohort size: overall ("simple"), by event time ("dynamic"), or by cohort ("group")."""
    keys: dict[str, list[Column]] = {"simple": [], "dynamic": [(F.col("period") - F.col("cohort")).alias("event_time")], "group": [F.col("cohort")]}
    att = (F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att")
    by = [*more, *keys[how]]
    return cells.groupBy(*by).agg(att) if by else cells.agg(att)


def group_time_bootstrap(df: DataFrame, y: str, unit: str, time: str, first: str, replicates: int, how: str = "simple", controls: str = "not_yet", seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The aggregate effects with error and percentile interval from units weighted anew, by Poisson weights of a hash of unit and replicate."""
    change, treated, control = _changes(df, y, unit, time, first, controls)
    each = change.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("w", F.when(F.col("b") == 0, 1).otherwise(poisson_weight(seed, "b", "unit")))
    mean = lambda on: F.sum(F.when(on, F.col("w") * F.col("dy"))) / F.sum(F.when(on, F.col("w")))
    cells = each.groupBy("b", "cohort", "t").agg(mean(treated).alias("x"), mean(control).alias("y"), F.sum(F.when(treated, F.col("w"))).alias("n_treated"))
    cells = cells.select("b", "cohort", F.col("t").alias("period"), (F.col("x") - F.col("y")).alias("att"), "n_treated").where("att IS NOT NULL")
    return percentile_interval(aggregate_effects(cells, how, ["b"]), "b", "att", alpha)


def lagged(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int) -> DataFrame:
    """IO4 and IO6: columns and their lags 1..lags within a series; rows without all lags go."""
    w = Window.partitionBy(series).orderBy(time)
    out = df.select(series, time, *columns, *[F.lag(c, k).over(w).alias(f"{c}_l{k}") for c in columns for k in range(1, lags + 1)], F.row_number().over(w).alias("row_"))
    return out.where(F.col("row_") > lags).drop("row_")


def stage_histories(df: DataFrame, key: str, stage: str, columns: Sequence[str], stages: Sequence[int]) -> DataFrame:
    """IO5: a row per key with every stage's columns as <column>_<stage>: the history of a stage is what has a smaller number."""
    pick = lambda c, s: F.max(F.when(F.col(stage) == s, F.col(c))).alias(f"{c}_{s}")
    return df.groupBy(key).agg(*[pick(c, s) for s in stages for c in columns])


def _bandwidth(n: Column) -> Column:
    return F.floor(4 * (n / 100) ** (2 / 9))


def hac_ols(df: DataFrame, y: str, xs: Sequence[str], series: str, time: str, bandwidth: int | None = None, kernel: str = "bartlett", alpha: float = 0.05) -> DataFrame:
    """Per series and coefficient (0 the intercept, then xs), least squares with errors by kernel-weighted products of scores up to ``bandwidth`` rows apart.

    The default bandwidth is 4 (T / 100)^(2/9), rounded down.  Kernels: bartlett, qs."""
    fit = LeastSquares(df, y, xs, [series], keep=[time])
    k, rows, small = len(xs) + 1, fit.rows, fit.small
    longest = int(small.agg(F.max("n")).first()[0] or 0)
    most = bandwidth if bandwidth is not None else int(4 * (longest / 100) ** (2 / 9))
    cols = [F.lit(1.0), *[F.col(f"x{j}_") for j in range(k - 1)]]
    both = join_by(rows, small.select(series, "slope"), [series])
    e = F.col("y_") - sum((F.col("slope")[j] * c for j, c in enumerate(cols)), F.lit(0.0))
    w = Window.partitionBy(series).orderBy(time)
    scored = both.select(series, time, *[(e * c).alias(f"s{j}") for j, c in enumerate(cols)])
    scored = scored.select("*", *[F.lag(f"s{j}", h).over(w).alias(f"s{j}_{h}") for j in range(k) for h in range(1, most + 1)])
    sums = [F.coalesce(F.sum(F.col(f"s{i}") * (F.col(f"s{j}") if h == 0 else F.col(f"s{j}_{h}"))), F.lit(0.0)) for h in range(most + 1) for i in range(k) for j in range(k)]
    meats = scored.groupBy(series).agg(F.array(*sums).alias("g"))
    names = ["intercept", *xs]

    def finish(r: dict) -> dict:
        n, b = r["n"], bandwidth if bandwidth is not None else int(4 * (r["n"] / 100) ** (2 / 9))
        gamma, inverse = np.array(r["g"]).reshape(most + 1, k, k), np.array(r["inverse"]).reshape(k, k)
        meat = gamma[0].copy()
        for h in range(1, most + 1):
            if kernel == "bartlett":
                weight = max(1 - h / (b + 1), 0.0)
            else:
                x = 6 * np.pi * h / (5 * (b + 1))
                weight = float(3 / x**2 * (np.sin(x) / x - np.cos(x)))
            meat += weight * (gamma[h] + gamma[h].T)
        to = np.eye(k)
        to[0, 1:] = [-m for m in r["at"][:-1]]
        cov = to @ inverse @ meat @ inverse @ to.T
        return {series: r[series], "se": np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), "n": n, "bandwidth": b}

    errors = each_row(join_by(small, meats, [series]), finish, ", ".join([*types(df, [series]), "se array<double>", "n long", "bandwidth long"]))
    out = join_by(fit.table.select(series, "beta"), errors, [series])
    out = out.select(series, F.posexplode("beta").alias("i", "estimate"), "se", "n", "bandwidth")
    out = out.select(series, F.element_at(F.lit(names), F.col("i") + 1).alias("term"), "estimate", F.col("se")[F.col("i")].alias("se"), "n", "bandwidth")
    return inferred(out, alpha)


def newey_west_mean(df: DataFrame, series: str, time: str, x: str, bandwidth: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Per series the mean and its error by Bartlett-weighted autocovariances; all lag products come from one window and one aggregate."""
    w = Window.partitionBy(series).orderBy(time)
    rows = frame(df, {"v": x}, [series], [time])
    per = join_by(rows, rows.groupBy(series).agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("t")), [series])
    most = bandwidth if bandwidth is not None else int(4 * ((per.agg(F.max("t")).first()[0] or 0) / 100) ** (2 / 9))
    width = F.lit(bandwidth) if bandwidth is not None else _bandwidth(F.col("t"))
    centred = per.select(series, time, "v", (F.col("v") - F.col("m")).alias("e"), width.alias("width"))
    lags = [F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, most + 1)]
    n = F.count(F.lit(1))
    long_run = F.sum(F.col("e") ** 2) / n
    for k in range(1, most + 1):
        weight = F.greatest(1 - k / (F.max("width") + 1), F.lit(0.0))
        long_run = long_run + 2 * weight * F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)) / n
    out = centred.select("*", *lags).groupBy(series).agg(F.avg("v").alias("mean"), F.sqrt(F.greatest(long_run, F.lit(0.0)) / n).alias("se"), n.alias("n"))
    return inferred(out, alpha, estimate="mean")
