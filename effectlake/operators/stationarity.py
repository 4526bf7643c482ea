"""Tests of unit roots and of stationarity with lags of each series' own choice.

A window over a series orders its rows; all that tests need is then sums per series and
its first and last few values, so that one pass serves every number of lags."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .moments import cross_products, each_row, frame, inverted, join_by, square, types
from .series import STATIONARITY, UNIT_ROOT, unit_root_p

#: Shorter series have no result.
SHORTEST = 10


def _longest(rows: DataFrame, series: str) -> int:
    return rows.groupBy(series).agg(F.count(F.lit(1)).alias("n__")).agg(F.max("n__")).first()[0] or 0


def _schwert(n: int, factor: int) -> int:
    return ceil(factor * (n / 100) ** 0.25)


def _numbered(rows: DataFrame, series: str, time: str, centre: bool) -> DataFrame:
    """series, y__ (v, less its series' mean with ``centre``), r__ (its number from 1) and n__ (the series' rows)."""
    whole = Window.partitionBy(series)
    level = F.col("v") - F.avg("v").over(whole) if centre else F.col("v")
    return rows.select(series, level.alias("y__"), F.row_number().over(whole.orderBy(time)).alias("r__"), F.count(F.lit(1)).over(whole).alias("n__"))


def unit_root_selected(df: DataFrame, series: str, time: str, x: str, regression: str = "c", criterion: str = "aic", most: int | None = None) -> DataFrame:
    """Per series the augmented test of a unit root with the number of lags, 0 to ``most``, whose regression has the least criterion ("aic", "bic"; "fixed" takes ``most``): lags, statistic, p_value, stationary (at 5 %), n (the rows of that regression).

    ``most`` is 12 (n / 100)^(1/4) of the series' own n, rounded up, where it isn't given,
    and at most n / 3 - 1.  Each number of lags is fitted on all rows that have so many.
    Changes are shifted copies of each other, so products of two lags depend on their
    distance alone, but for a few rows at both ends: one pass sums ``most`` products
    and keeps the ends, and every regression is algebra of these.  Series of less than
    ten rows, or of one value, have nulls; rows with a null are left out."""
    if regression not in UNIT_ROOT or criterion not in ("aic", "bic", "fixed"):
        raise ValueError(f"regression {regression!r} or criterion {criterion!r} is unknown")
    rows = frame(df, {"v": x}, [series], [time])
    longest = _longest(rows, series)
    m = max(0, min(most if most is not None else _schwert(longest, 12), longest // 3 - 1))
    w = Window.partitionBy(series).orderBy("r__")
    own = _numbered(rows, series, time, regression != "n").withColumn("d__", F.col("y__") - F.lag("y__").over(w))
    own = own.select("*", F.lag("y__").over(w).alias("l__"), *[F.lag("d__", k).over(w).alias(f"d{k}__") for k in range(1, m + 1)])
    change = [F.col("d__"), *[F.col(f"d{k}__") for k in range(1, m + 1)]]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    end = lambda near: F.collect_list(F.when(near, F.struct(F.col("r__").cast("long").alias("r"), F.col("y__").alias("y"))))
    sums = own.groupBy(series).agg(
        F.max("n__").alias("n"),
        F.array(*[total(F.col("d__") * c) for c in change]).alias("dd"),
        F.array(total(F.col("l__") * F.col("d__")), *[total(F.col("y__") * c) for c in change]).alias("yd"),
        F.array(total(F.col("y__")), total(F.col("y__") ** 2), total(F.col("r__") * F.col("y__")), total(F.col("d__")), total(F.col("r__") * F.col("d__"))).alias("one"),
        end((F.col("r__") <= m + 2) | (F.col("r__") > F.col("n__") - m - 2)).alias("ends"),
    )

    def products(r: dict, lags: int, known: dict[int, float]) -> np.ndarray:
        """Of the last level, the last changes, the constant and the trend in use, and the change, over the rows that have so many lags."""
        n, k = r["n"], lags + 1
        middle = (n + 1) / 2
        y1, y2, ty, d1, td = r["one"]
        fixed = {"n": 0, "c": 1, "ct": 2}[regression]
        at = [*range(1, k), k + fixed]  # where changes stand: lags 1, 2, ... and the change itself
        shift = [*range(1, k), 0]
        g = np.zeros((k + fixed + 1, k + fixed + 1))
        g[0, 0] = y2
        for i, a in zip(at, shift, strict=True):
            g[0, i] = r["yd"][a]
            for j, b in zip(at, shift, strict=True):
                g[i, j] = r["dd"][abs(a - b)]
            for c, value in enumerate((d1, td + (a - middle) * d1)[:fixed]):
                g[k + c, i] = g[i, k + c] = value
        for c, value in enumerate((y1, ty + (1 - middle) * y1)[:fixed]):
            g[0, k + c] = value
        level = lambda s: known.get(s, 0.0) if 1 <= s <= n else 0.0
        step = lambda s: level(s) - level(s - 1) if 2 <= s <= n else 0.0
        ends = [*range(1, lags + 2), *range(n + 1, n + max(lags, 1) + 1)]
        z = np.array([[level(t - 1), *[step(t - i) for i in range(1, k)], *(1.0, t - middle)[:fixed], step(t)] for t in ends])
        g = np.triu(g) + np.triu(g, 1).T - z.T @ z
        # The constant and the trend are not shifted copies: their own products are those of the rows in use.
        used, first = n - lags - 1, lags + 2 - middle
        sums = (used, used * (first + (n - middle)) / 2, used * ((first + n - middle) / 2) ** 2 + used * (used**2 - 1) / 12)
        for a in range(fixed):
            for b in range(fixed):
                g[k + a, k + b] = sums[a + b]
        return g

    def fit(r: dict) -> dict:
        n = r["n"]
        base = {series: r[series], **dict.fromkeys(("lags", "statistic", "p_value", "stationary", "n"))}
        if n < SHORTEST:
            return base
        known = {e["r"]: e["y"] for e in r["ends"] if e is not None}
        own_most, found = max(0, min(most if most is not None else _schwert(n, 12), n // 3 - 1)), []
        for lags in range(own_most, own_most + 1) if criterion == "fixed" else range(own_most + 1):
            g, used = products(r, lags, known), n - lags - 1
            k = len(g) - 1
            if used < 5 or used <= k:
                continue
            inverse, alone = inverted(g[:-1, :-1])
            b = inverse @ g[:-1, -1]
            rss = float(g[-1, -1] - b @ g[:-1, -1])
            if not alone[0] or not rss > 1e-13 * g[-1, -1]:
                continue
            price = 2.0 if criterion == "aic" else float(np.log(used))
            found.append((used * np.log(rss / used) + price * k, lags, float(b[0] / np.sqrt(rss / (used - k) * inverse[0, 0])), used))
        if not found:
            return base
        _, lags, tau, used = min(found)
        return {**base, "lags": lags, "statistic": tau, "p_value": unit_root_p(tau, regression), "stationary": bool(tau < UNIT_ROOT[regression][1]), "n": used}

    return each_row(sums, fit, ", ".join([*types(df, [series]), "lags long, statistic double, p_value double, stationary boolean, n long"]))


def _variances(own: DataFrame, series: str, most: int, bandwidth: int | None, *more: Column) -> DataFrame:
    """series, n, short (the mean square of e__) and long (its Bartlett long-run variance) of a numbered series, and ``more`` aggregates; the bandwidth is 4 (n / 100)^(1/4) of the series' own rows, rounded up, where it isn't given."""
    w = Window.partitionBy(series).orderBy("r__")
    own = own.select("*", *[F.lag("e__", k).over(w).alias(f"e{k}__") for k in range(1, most + 1)])
    width = F.lit(bandwidth) if bandwidth is not None else F.ceil(4 * F.pow(F.max("n__") / 100, F.lit(0.25)))
    n = F.count(F.lit(1))
    long = F.sum(F.col("e__") ** 2)
    for k in range(1, most + 1):
        long = long + 2 * F.greatest(1 - k / (width + 1), F.lit(0.0)) * F.coalesce(F.sum(F.col("e__") * F.col(f"e{k}__")), F.lit(0.0))
    return own.groupBy(series).agg(n.alias("n"), F.max("n__").alias("rows"), (F.sum(F.col("e__") ** 2) / n).alias("short"), (long / n).alias("long"), *more)


def phillips_perron(df: DataFrame, series: str, time: str, x: str, regression: str = "c", bandwidth: int | None = None) -> DataFrame:
    """Per series the unit-root test without lags whose statistic is corrected by the long-run variance of what is left (Phillips and Perron 1988): statistic, rho_statistic, p_value, stationary (at 5 %), n (changes).

    The bandwidth is 4 (n / 100)^(1/4) of the series' own rows, rounded up, where it
    isn't given; a long-run variance that isn't positive is replaced by the plain one.
    Series of less than ten rows, or that are fitted exactly, have nulls."""
    if regression not in UNIT_ROOT:
        raise ValueError(f"regression {regression!r} is unknown")
    rows = frame(df, {"v": x}, [series], [time])
    most = bandwidth if bandwidth is not None else _schwert(_longest(rows, series), 4)
    w = Window.partitionBy(series).orderBy("r__")
    own = _numbered(rows, series, time, regression != "n").withColumn("l__", F.lag("y__").over(w)).where("l__ IS NOT NULL")
    cols = [F.col("l__"), *[F.lit(1.0), F.col("r__") - (F.col("n__") + 2) / 2][: {"n": 0, "c": 1, "ct": 2}[regression]]]
    k = len(cols)

    def fit(r: dict) -> dict:
        base = {series: r[series], "b": None, "se": None, "s2": None}
        g = square(r["xx"], k + 1)
        inverse, alone = inverted(g[:-1, :-1])
        b = inverse @ g[:-1, -1]
        rss = float(g[-1, -1] - b @ g[:-1, -1])
        if r["n"] < SHORTEST - 1 or r["n"] <= k or not alone[0] or not rss > 1e-13 * g[-1, -1]:
            return base
        s2 = rss / (r["n"] - k)
        return {**base, "b": b.tolist(), "se": float(np.sqrt(s2 * inverse[0, 0])), "s2": s2}

    fits = each_row(cross_products(own, [*cols, F.col("y__") - F.col("l__")], [series]), fit, ", ".join([*types(df, [series]), "b array<double>, se double, s2 double"]))
    both = join_by(own, fits, [series])
    left = both.withColumn("e__", F.col("y__") - F.col("l__") - sum((F.col("b")[i] * c for i, c in enumerate(cols)), F.lit(0.0)))
    sums = _variances(left, series, most, bandwidth, F.any_value("b").alias("b"), F.any_value("se").alias("se"), F.any_value("s2").alias("s2"))

    def finish(r: dict) -> dict:
        base = {series: r[series], **dict.fromkeys(("statistic", "rho_statistic", "p_value", "stationary")), "n": r["n"]}
        if r["b"] is None:
            return base
        rho, t, short = r["b"][0], r["n"], r["short"]
        long = r["long"] if r["long"] > 0 else short
        spread = t * r["se"] / np.sqrt(r["s2"])
        z = float(np.sqrt(short / long) * rho / r["se"] - 0.5 * (long - short) / np.sqrt(long) * spread)
        return {**base, "statistic": z, "rho_statistic": float(t * rho - 0.5 * spread**2 * (long - short)), "p_value": unit_root_p(z, regression), "stationary": bool(z < UNIT_ROOT[regression][1])}

    return each_row(sums, finish, ", ".join([*types(df, [series]), "statistic double, rho_statistic double, p_value double, stationary boolean, n long"]))


def stationarity_around(df: DataFrame, series: str, time: str, x: str, regression: str = "ct", bandwidth: int | None = None) -> DataFrame:
    """Per series the test of stationarity around a level ("c") or a trend ("ct"): cumulative sums of what is left, squared and summed, over n^2 times its Bartlett long-run variance: statistic, p_value (0.01 to 0.10, the ends of its table), stationary (at 5 %), n.

    The bandwidth is 4 (n / 100)^(1/4) of the series' own rows, rounded up, where it
    isn't given.  Series of less than ten rows, or without variance, have nulls."""
    if regression not in STATIONARITY:
        raise ValueError(f"regression {regression!r} is unknown")
    rows = frame(df, {"v": x}, [series], [time])
    most = bandwidth if bandwidth is not None else _schwert(_longest(rows, series), 4)
    own, whole = _numbered(rows, series, time, True), Window.partitionBy(series)
    trend = F.try_divide(F.covar_pop("y__", "r__").over(whole), F.var_pop("r__").over(whole)) * (F.col("r__") - (F.col("n__") + 1) / 2) if regression == "ct" else F.lit(0.0)
    own = own.withColumn("e__", F.col("y__") - trend)
    own = own.withColumn("sum__", F.sum("e__").over(whole.orderBy("r__").rowsBetween(Window.unboundedPreceding, 0)))
    sums = _variances(own, series, most, bandwidth, F.sum(F.col("sum__") ** 2).alias("squares"))

    def finish(r: dict) -> dict:
        base = {series: r[series], "statistic": None, "p_value": None, "stationary": None, "n": r["n"]}
        if r["n"] < SHORTEST or r["long"] is None or not r["long"] > 0:
            return base
        s = r["squares"] / r["n"] ** 2 / r["long"]
        limits = STATIONARITY[regression]
        return {**base, "statistic": s, "p_value": float(np.interp(s, limits, [0.10, 0.05, 0.025, 0.01])), "stationary": bool(s < limits[1])}

    return each_row(sums, finish, ", ".join([*types(df, [series]), "statistic double, p_value double, stationary boolean, n long"]))


def confirmed_stationarity(df: DataFrame, series: str, time: str, x: str, regression: str = "c", criterion: str = "aic") -> DataFrame:
    """Per series both tests, of a unit root and of stationarity, and what they say together: unit_root (its statistic), lags, around (the other's statistic), conclusion ("stationary", "non-stationary", "inconclusive") and reason.

    Where both reject, or neither, it is inconclusive; null where a test has no result."""
    root = unit_root_selected(df, series, time, x, regression, criterion).select(series, F.col("statistic").alias("unit_root"), "lags", F.col("stationary").alias("a__"))
    around = stationarity_around(df, series, time, x, regression).select(series, F.col("statistic").alias("around"), F.col("stationary").alias("b__"))
    a, b = F.col("a__"), F.col("b__")
    conclusion = F.when(a & b, "stationary").when(~a & ~b, "non-stationary").when(a.isNotNull() & b.isNotNull(), "inconclusive")
    reason = F.when(a & b, "a unit root is rejected, stationarity is not").when(~a & ~b, "stationarity is rejected, a unit root is not").when(a & ~b, "both are rejected").when(~a & b, "neither is rejected")
    return join_by(root, around, [series]).select(series, "unit_root", "lags", "around", conclusion.alias("conclusion"), reason.alias("reason"))
