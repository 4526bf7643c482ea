"""Time series by segment: each series is reduced to the cross-products of its lags, and those are solved per series.

A window over a series orders its rows, so a series is as long as one task can
sort; the number of series is unbounded."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .moments import LeastSquares, cross_products, each_row, frame, inverted, join_by, left_over, log_determinant, number, square, types

#: Critical values of the unit-root test at 1, 5 and 10 %, with a constant, with a trend, with neither.
UNIT_ROOT = {"c": (-3.430, -2.862, -2.567), "ct": (-3.960, -3.410, -3.127), "n": (-2.576, -1.941, -1.616)}
#: The limiting distribution of the statistic (Fuller 1976, table 8.5.2), at probabilities 0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99.
UNIT_ROOT_LAW = {"n": (-2.58, -2.23, -1.95, -1.62, 0.89, 1.28, 1.62, 2.00), "c": (-3.43, -3.12, -2.86, -2.57, -0.44, -0.07, 0.23, 0.60), "ct": (-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33)}
UNIT_ROOT_PROBABILITIES = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
#: Critical values of the two-step cointegration test at 1, 5 and 10 %.
COINTEGRATION = (-3.90, -3.34, -3.04)
#: Critical values of the stationarity test at 10, 5, 2.5 and 1 %, around a level and around a trend.
STATIONARITY = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def _lags(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int) -> DataFrame:
    """v0_0, v0_1, ...: each column and its lags, centred on the series' means; rows without all lags are gone."""
    rows = frame(df, {f"c{i}": c for i, c in enumerate(columns)}, [series], [time])
    means = rows.groupBy(F.col(series).alias("s__")).agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(columns))])
    own = rows.join(means, F.col(series).eqNullSafe(F.col("s__"))).select(series, F.col(time).alias("time__"), *[(F.col(f"c{i}") - F.col(f"m{i}")).alias(f"v{i}_0") for i in range(len(columns))])
    w = Window.partitionBy(series).orderBy("time__")
    out = own.select("*", *[F.lag(f"v{i}_0", k).over(w).alias(f"v{i}_{k}") for i in range(len(columns)) for k in range(1, lags + 1)], F.row_number().over(w).alias("row__"))
    return out.where(F.col("row__") > lags)


def _gram(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int) -> DataFrame:
    own = _lags(df, series, time, columns, lags)
    return cross_products(own, [F.lit(1.0), *[F.col(f"v{i}_{k}") for k in range(lags + 1) for i in range(len(columns))]], [series])


def vector_autoregression(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int) -> DataFrame:
    """S3: per series n, coef (equations x regressors by rows: the intercept at the series' means, then lag 1 of all columns, lag 2, ...), sigma (the residuals' covariance with n less the regressors), loglik, aic, bic, hqc."""
    k, p = len(columns), 1 + len(columns) * lags

    def fit(r: dict) -> dict:
        base = {series: r[series], "n": r["n"], **dict.fromkeys(("coef", "sigma", "loglik", "aic", "bic", "hqc"))}
        n = r["n"]
        if n <= p:
            return base
        m = square(r["xx"], 1 + k * (lags + 1))
        now, past = [*range(1, 1 + k)], [0, *range(1 + k, 1 + k * (lags + 1))]
        b = inverted(m[np.ix_(past, past)])[0] @ m[np.ix_(past, now)]
        left = m[np.ix_(now, now)] - m[np.ix_(now, past)] @ b
        det = log_determinant(left / n)
        out = {**base, "coef": b.T.ravel().tolist(), "sigma": (left / (n - p)).ravel().tolist()}
        if np.isfinite(det):
            like, q = float(-n / 2 * (k * np.log(2 * np.pi) + det + k)), k * p
            out |= {"loglik": like, "aic": -2 * like + 2 * q, "bic": -2 * like + q * float(np.log(n)), "hqc": -2 * like + 2 * q * float(np.log(np.log(n)))}
        return out

    return each_row(_gram(df, series, time, columns, lags), fit, ", ".join([*types(df, [series]), "n long, coef array<double>, sigma array<double>, loglik double, aic double, bic double, hqc double"]))


def select_lags(df: DataFrame, series: str, time: str, columns: Sequence[str], most: int) -> DataFrame:
    """S3: per series the number of lags, 1 to ``most``, with the least aic, bic and hqc; all are fitted on the same rows, those with ``most`` lags, from one Gram matrix."""
    k = len(columns)

    def fit(r: dict) -> dict:
        n, m, found = r["n"], square(r["xx"], 1 + k * (most + 1)), {"aic": [], "bic": [], "hqc": []}
        for lags in range(1, most + 1):
            now, past = [*range(1, 1 + k)], [0, *range(1 + k, 1 + k * (lags + 1))]
            if n <= len(past):
                break
            det, q = log_determinant(left_over(m, past, now) / n), k * len(past)
            if np.isfinite(det):
                like = -n / 2 * (k * np.log(2 * np.pi) + det + k)
                for name, cost in (("aic", 2.0), ("bic", np.log(n)), ("hqc", 2 * np.log(np.log(n)))):
                    found[name].append((-2 * like + q * cost, lags))
        return {series: r[series], "n": n, **{name: min(x)[1] if x else None for name, x in found.items()}}

    return each_row(_gram(df, series, time, columns, most), fit, ", ".join([*types(df, [series]), "n long, aic long, bic long, hqc long"]))


def granger(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, joint: bool = False) -> DataFrame:
    """Per series and ordered pair (cause, effect) the F test that the cause's lags don't help beside the effect's own (beside all others' with ``joint``): f, df1, df2, p_value; every pair reads blocks of one Gram matrix."""
    k = len(columns)
    at = lambda i: [1 + k * h + i for h in range(1, lags + 1)]

    def fit(r: dict) -> dict:
        n, m, xs = r["n"], square(r["xx"], 1 + k * (lags + 1)), []

        def rss(effect: int, past: list[int]) -> float:
            return float(left_over(m, past, [1 + effect])[0, 0])

        for c in range(k):
            for e in range(k):
                if c == e:
                    continue
                full = [0, *at(e), *at(c), *([i for o in range(k) if o not in (c, e) for i in at(o)] if joint else [])]
                spare = n - len(full)
                if spare <= 0:
                    continue
                r1, r0 = rss(e, full), rss(e, [i for i in full if i not in at(c)])
                f = max((r0 - r1) / lags / (r1 / spare), 0.0) if r1 > 0 else None
                xs.append((columns[c], columns[e], f, lags, spare, None if f is None else stats.f_tail(f, lags, spare)))
        return {series: r[series], "n": n, "xs": xs}

    table = each_row(_gram(df, series, time, columns, lags), fit, ", ".join([*types(df, [series]), "n long, xs array<struct<cause:string,effect:string,f:double,df1:long,df2:long,p_value:double>>"]))
    return table.select(series, "n", F.explode("xs").alias("x")).select(series, "x.*", "n")


def unit_root_p(tau: float, regression: str) -> float:
    """The statistic's probability by the tabled law, interpolated as normal quantiles are; at most as far out as the table goes, 0.01 or 0.99."""
    z = [stats.normal_quantile(p) for p in UNIT_ROOT_PROBABILITIES]
    return stats.normal_cdf(float(np.interp(tau, UNIT_ROOT_LAW[regression], z)))


def unit_root_test(df: DataFrame, series: str, time: str, x: str, lags: int, regression: str = "c") -> DataFrame:
    """Per series the augmented test of a unit root: the change of x on its last level, ``lags`` last changes and a constant ("c"), trend ("ct") or neither ("n"): statistic, p_value, stationary (at 5 %), n."""
    rows = frame(df, {"v": x}, [series], [time])
    w = Window.partitionBy(series).orderBy(time)
    rows = rows.select(series, time, "v", F.lag("v").over(w).alias("level"), (F.col("v") - F.lag("v").over(w)).alias("d"), F.row_number().over(w).alias("row"))
    rows = rows.select("*", *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)]).where(F.col("row") > lags + 1)
    means = rows.groupBy(F.col(series).alias("s__")).agg(F.avg("level").alias("m__"), F.avg("row").alias("r__"))
    both = rows.join(means, F.col(series).eqNullSafe(F.col("s__")))
    shift = F.col("m__") if regression != "n" else F.lit(0.0)
    more = {"c": [F.lit(1.0)], "ct": [F.lit(1.0), F.col("row") - F.col("r__")], "n": []}[regression]
    cols = [F.col("level") - shift, *[F.col(f"d{k}") for k in range(1, lags + 1)], *more, F.col("d")]
    k = len(cols) - 1

    def fit(r: dict) -> dict:
        base = {series: r[series], "statistic": None, "p_value": None, "stationary": None, "n": r["n"]}
        if r["n"] <= k + 1:
            return base
        m = square(r["xx"], k + 1)
        inverse, known = inverted(m[:-1, :-1])
        if not known[0]:
            return base
        b = inverse @ m[:-1, -1]
        s2 = (m[-1, -1] - b @ m[:-1, -1]) / (r["n"] - k)
        if not s2 * inverse[0, 0] > 0:
            return base
        tau = float(b[0] / np.sqrt(s2 * inverse[0, 0]))
        return {**base, "statistic": tau, "p_value": unit_root_p(tau, regression), "stationary": bool(tau < UNIT_ROOT[regression][1])}

    return each_row(cross_products(both, cols, [series]), fit, ", ".join([*types(df, [series]), "statistic double, p_value double, stationary boolean, n long"]))


def stationarity_test(df: DataFrame, series: str, time: str, x: str, bandwidth: int | None = None) -> DataFrame:
    """Per series the test of stationarity around a level: the cumulative sums of x less its mean, squared and summed, over n^2 times the Bartlett long-run variance: statistic, p_value, stationary (at 5 %), n.

    The default bandwidth is 4 (n / 100)^(1/4), rounded down, at the longest series' n."""
    rows = frame(df, {"v": x}, [series], [time])
    means = rows.groupBy(F.col(series).alias("s__")).agg(F.avg("v").alias("m__"), F.count(F.lit(1)).alias("t__"))
    most = bandwidth if bandwidth is not None else int(4 * ((means.agg(F.max("t__")).first()[0] or 0) / 100) ** 0.25)
    w = Window.partitionBy(series).orderBy(time)
    own = rows.join(means, F.col(series).eqNullSafe(F.col("s__"))).select(series, time, (F.col("v") - F.col("m__")).alias("e"))
    own = own.select("*", F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum__"), *[F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, most + 1)])
    n = F.count(F.lit(1))
    long_run = F.sum(F.col("e") ** 2) / n
    for k in range(1, most + 1):
        long_run = long_run + 2 * (1 - k / (most + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)) / n
    sums = own.groupBy(series).agg((F.sum(F.col("sum__") ** 2) / n**2 / long_run).alias("statistic"), n.alias("n"))
    ten, five, two, one = STATIONARITY["c"]

    def tail(r: dict) -> dict:
        s = r["statistic"]
        p = None if s is None else float(np.interp(s, [ten, five, two, one], [0.10, 0.05, 0.025, 0.01]))  # 0.10 and 0.01 beyond the table
        return {**r, "p_value": p, "stationary": None if s is None else bool(s < five)}

    return each_row(sums, tail, ", ".join([*types(df, [series]), "statistic double, n long, p_value double, stationary boolean"]))


def local_projections(df: DataFrame, series: str, time: str, response: str, shock: str, lags: int, horizons: int) -> DataFrame:
    """Per series and horizon h the coefficient of the shock in a regression of the response h rows on, on the shock and ``lags`` lags of both, with Bartlett errors of bandwidth h: estimate, se, n."""
    rows = _lags(df, series, time, [response, shock], lags)
    own = Window.partitionBy(series).orderBy("time__")
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.lead("v0_0", h).over(own).alias("ahead__")) for h in range(horizons + 1)])
    lead = rows.withColumn("a__", ahead).select("*", F.explode("a__").alias("x__")).select(*rows.columns, "x__.h", "x__.ahead__").where("ahead__ IS NOT NULL")
    w = Window.partitionBy(series, "h").orderBy("time__")
    cols = [F.lit(1.0), F.col("v1_0"), *[F.col(f"v{i}_{k}") for k in range(1, lags + 1) for i in (0, 1)]]
    k = len(cols)
    grams = cross_products(lead, [*cols, F.col("ahead__")], [series, "h"])

    def fit(r: dict) -> dict:
        m = square(r["xx"], k + 1)
        inverse, _ = inverted(m[:-1, :-1])
        return {series: r[series], "h": r["h"], "n": r["n"], "b": (inverse @ m[:-1, -1]).tolist(), "row": inverse[1].tolist()}

    small = each_row(grams, fit, ", ".join([*types(df, [series]), "h int, n long, b array<double>, row array<double>"]))
    keyed = small.withColumnsRenamed({series: "s__", "h": "h__"})
    both = lead.join(keyed, F.col(series).eqNullSafe(F.col("s__")) & (F.col("h") == F.col("h__")))
    e = F.col("ahead__") - sum((F.col("b")[i] * c for i, c in enumerate(cols)), F.lit(0.0))
    score = e * sum((F.col("row")[i] * c for i, c in enumerate(cols)), F.lit(0.0))
    own = both.select(series, "h", "time__", score.alias("score__"), "n", F.col("b")[1].alias("estimate"))
    own = own.select("*", *[F.lag("score__", j).over(w).alias(f"score__{j}") for j in range(1, horizons + 1)])
    var = F.sum(F.col("score__") ** 2)
    for j in range(1, horizons + 1):
        var = var + 2 * F.greatest(1 - j / (F.max("h") + 1), F.lit(0.0)) * F.coalesce(F.sum(F.col("score__") * F.col(f"score__{j}")), F.lit(0.0))
    return own.groupBy(series, "h").agg(F.max("estimate").alias("estimate"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"), F.max("n").alias("n")).withColumn("h", F.col("h").cast("long"))


def difference(df: DataFrame, series: str, time: str, x: str, order: int = 1) -> DataFrame:
    """Df and <x>_diff, differenced ``order`` times within its series; rows without it are gone."""
    w, out = Window.partitionBy(series).orderBy(time), df.withColumn(f"{x}_diff", number(x))
    for _ in range(order):
        out = out.withColumn(f"{x}_diff", F.col(f"{x}_diff") - F.lag(f"{x}_diff").over(w))
    return out.where(F.col(f"{x}_diff").isNotNull())


def vector_forecast(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, steps: int) -> DataFrame:
    """Per series, step and column the forecast of its vector autoregression, from the last ``lags`` rows on."""
    k = len(columns)
    fits = vector_autoregression(df, series, time, columns, lags).select(series, "coef")
    rows = frame(df, {f"c{i}": c for i, c in enumerate(columns)}, [series], [time])
    last = rows.withColumn("r__", F.row_number().over(Window.partitionBy(series).orderBy(F.col(time).desc()))).where(F.col("r__") <= lags)
    means = rows.groupBy(series).agg(F.array(*[F.avg(f"c{i}") for i in range(k)]).alias("m"), F.count(F.lit(1)).alias("t"))
    packed = last.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("r__", *[f"c{i}" for i in range(k)]))).alias("past"))  # ``lags`` rows

    def run(r: dict) -> dict:
        out = []
        if r["coef"] is not None and len(r["past"]) == lags:
            b, m = np.array(r["coef"]).reshape(k, 1 + k * lags), np.array(r["m"])
            past = [np.array([x[f"c{i}"] for i in range(k)]) - m for x in r["past"]]  # the latest first
            for step in range(1, steps + 1):
                now = b @ np.concatenate([[1.0], *past])
                past = [now, *past[:-1]]
                out += [(step, c, float(v)) for c, v in zip(columns, now + m, strict=True)]
        return {series: r[series], "xs": out}

    table = each_row(join_by(join_by(packed, means, [series]), fits, [series]), run, ", ".join([*types(df, [series]), "xs array<struct<step:long,variable:string,forecast:double>>"]))
    return table.select(series, F.explode("xs").alias("x")).select(series, "x.*")


def impulse_responses(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, horizons: int, structural: bool = True, long_run: bool = False) -> DataFrame:
    """Per series, horizon, response and shock the response of the vector autoregression to a shock of one standard deviation, shocks being orthogonal in order of ``columns`` (the Cholesky factor of the residuals' covariance), and its share of the response's forecast-error variance; with structural=False to a unit residual, without shares.

    With ``long_run`` shocks are told apart by their effects in the long run: the sum of a
    response over all horizons is nothing for a shock that comes later in ``columns``
    (Blanchard and Quah 1989).  Series whose autoregression is not stable have none, and no rows."""
    k = len(columns)

    def run(r: dict) -> dict:
        out = []
        if r["coef"] is not None:
            b = np.array(r["coef"]).reshape(k, 1 + k * lags)[:, 1:].reshape(k, lags, k)
            psi = [np.eye(k)]
            for h in range(1, horizons + 1):
                psi.append(sum((b[:, j - 1, :] @ psi[h - j] for j in range(1, min(h, lags) + 1)), np.zeros((k, k))))
            sigma = np.array(r["sigma"]).reshape(k, k)
            impact = np.linalg.cholesky(sigma) if structural else np.eye(k)
            if long_run:
                companion = np.eye(k * lags, k=-k)
                companion[:k] = b.reshape(k, lags * k)
                if np.abs(np.linalg.eigvals(companion)).max() >= 1:
                    return {series: r[series], "xs": []}
                total = np.linalg.inv(np.eye(k) - b.sum(1))
                impact = np.linalg.solve(total, np.linalg.cholesky(total @ sigma @ total.T))
            seen = np.zeros((k, k))
            for h, p in enumerate(psi):
                response = p @ impact
                seen += response**2
                share = seen / seen.sum(1, keepdims=True) if structural or long_run else np.full((k, k), np.nan)
                out += [(h, columns[i], columns[j], float(response[i, j]), float(share[i, j]) if structural or long_run else None) for i in range(k) for j in range(k)]
        return {series: r[series], "xs": out}

    table = each_row(vector_autoregression(df, series, time, columns, lags), run, ", ".join([*types(df, [series]), "xs array<struct<h:long,response:string,shock:string,value:double,share:double>>"]))
    return table.select(series, F.explode("xs").alias("x")).select(series, "x.*")


def cointegration_test(df: DataFrame, series: str, time: str, y: str, xs: Sequence[str], lags: int) -> DataFrame:
    """Per series the two-step test: y on xs by least squares, and the unit-root statistic (without a constant) of what is left, against the critical values of two variables: statistic, cointegrated (at 5 %), n."""
    fit = LeastSquares(df, y, xs, [series], keep=[time])
    cols = [F.lit(1.0), *[F.col(f"x{j}_") for j in range(len(xs))]]
    both = join_by(fit.rows, fit.small.select(series, "slope"), [series])
    left = both.select(series, time, (F.col("y_") - sum((F.col("slope")[j] * c for j, c in enumerate(cols)), F.lit(0.0))).alias("left__"))
    out = unit_root_test(left, series, time, "left__", lags, "n")
    return out.select(series, "statistic", (F.col("statistic") < COINTEGRATION[1]).alias("cointegrated"), "n")
