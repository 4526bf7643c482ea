"""Causal links between lagged series, structural shocks from an outside instrument, and what shocks made of a series' history.

Links are tested per series on one Gram matrix of all lagged columns, solved in tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .moments import cross_products, each_row, frame, inverted, join_by, square, types
from .series import _gram, _lags, vector_autoregression


def _partial(cov: np.ndarray, a: int, b: int, given: Sequence[int], n: int) -> tuple[float, float]:
    """The partial correlation of two columns given others, and its p-value by Student's t."""
    at = [a, b, *given]
    p = inverted(cov[np.ix_(at, at)])[0][:2, :2]
    r = float(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1])) if p[0, 0] > 0 and p[1, 1] > 0 else 0.0
    spare = n - len(given) - 2
    if spare <= 0 or abs(r) >= 1:
        return r, 0.0 if abs(r) >= 1 else 1.0
    return r, float(stats.two_sided(float(r * np.sqrt(spare / (1 - r * r))), 1.0, spare))


def lagged_links(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, level: float = 0.05, most_parents: int | None = None) -> DataFrame:
    """Per series, source, lag (1 to ``lags``) and target the partial correlation given the target's other parents and the source's own, its p-value, whether it is a link at ``level``, n.

    Parents of a target are first thinned out: all lagged columns are candidates, and at
    step p those go that are independent of it given the p strongest others, decided for
    all candidates of a step before any goes, so that their order makes no difference.
    All tests read one Gram matrix of the columns at up to 2 ``lags`` lags."""
    k = len(columns)
    at = lambda i, lag: 1 + lag * k + i

    def test(r: dict) -> dict:
        n, xs = r["n"], []
        if n <= k * 2 * lags + 3:
            return {series: r[series], "n": n, "xs": xs}
        m = square(r["xx"], 1 + k * (2 * lags + 1))
        cov = m - np.outer(m[0], m[0]) / n
        parents: list[list[tuple[int, int]]] = []
        for j in range(k):
            strength = {(i, lag): np.inf for i in range(k) for lag in range(1, lags + 1)}
            p = 0
            while len(strength) > p and (most_parents is None or p <= most_parents):
                order, gone = sorted(strength, key=lambda c: (-strength[c], c)), []
                for c in order:
                    given = [at(*o) for o in order if o != c][:p]
                    value, chance = _partial(cov, at(*c), at(j, 0), given, n)
                    strength[c] = min(strength[c], abs(value))
                    if chance > level:
                        gone.append(c)
                for c in gone:
                    del strength[c]
                p += 1
            parents.append(sorted(strength, key=lambda c: (-strength[c], c)))
        for j in range(k):
            for i in range(k):
                for lag in range(1, lags + 1):
                    given = {at(*c) for c in parents[j] if c != (i, lag)} | {at(o, q + lag) for o, q in parents[i]}
                    value, chance = _partial(cov, at(i, lag), at(j, 0), sorted(given - {at(i, lag), at(j, 0)}), n)
                    xs.append((columns[i], lag, columns[j], float(value), chance, bool(chance <= level)))
        return {series: r[series], "n": n, "xs": xs}

    table = each_row(_gram(df, series, time, columns, 2 * lags), test, ", ".join([*types(df, [series]), "n long, xs array<struct<source:string,lag:long,target:string,partial:double,p_value:double,link:boolean>>"]))
    return table.select(series, "n", F.explode("xs").alias("x")).select(series, "x.*", "n")


def _residuals(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int) -> DataFrame:
    """series, time__, u0, u1, ...: what a vector autoregression leaves of each row, with its coef and sigma."""
    k = len(columns)
    fits = vector_autoregression(df, series, time, columns, lags).where("coef IS NOT NULL").select(series, "coef", "sigma")
    rows = join_by(_lags(df, series, time, columns, lags), fits, [series])
    past = [F.lit(1.0), *[F.col(f"v{i}_{h}") for h in range(1, lags + 1) for i in range(k)]]
    line = lambda i: sum((F.col("coef")[i * len(past) + j] * c for j, c in enumerate(past)), F.lit(0.0))
    return rows.select(series, "time__", "coef", "sigma", *[(F.col(f"v{i}_0") - line(i)).alias(f"u{i}") for i in range(k)])


def proxy_impacts(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, instrument: str, target: str) -> DataFrame:
    """Per series and column the impact of the structural shock that the instrument stands for, scaled to 1 on ``target``: impact, first_stage_f, first_stage_r2, weak (F below 10), n.

    The residuals of a vector autoregression are regressed on what the instrument
    explains of the target's; rows without the instrument are left out."""
    k, t = len(columns), list(columns).index(target)
    own = _residuals(df, series, time, columns, lags)
    z = frame(df, {"z": instrument}, [series], [time]).withColumnsRenamed({series: "s__", time: "t__"})
    both = own.join(z, F.col(series).eqNullSafe(F.col("s__")) & (F.col("time__") == F.col("t__")))
    mean = both.groupBy(F.col(series).alias("s2__")).agg(F.avg("z").alias("m__"))
    both = both.join(mean, F.col(series).eqNullSafe(F.col("s2__"))).withColumn("z", F.col("z") - F.col("m__"))
    grams = cross_products(both, [F.lit(1.0), F.col("z"), *[F.col(f"u{i}") for i in range(k)]], [series])

    def fit(r: dict) -> dict:
        n, m = r["n"], square(r["xx"], k + 2)
        m = m - np.outer(m[0], m[0]) / n
        xs = []
        if n > 3 and m[1, 1] > 0 and m[1, 2 + t] != 0:
            r2 = float(m[1, 2 + t] ** 2 / (m[1, 1] * m[2 + t, 2 + t]))
            f = r2 / (1 - r2) * (n - 2) if r2 < 1 else None
            xs = [(c, float(m[1, 2 + i] / m[1, 2 + t]), f, r2, f is not None and f < 10) for i, c in enumerate(columns)]
        return {series: r[series], "n": n, "xs": xs}

    table = each_row(grams, fit, ", ".join([*types(df, [series]), "n long, xs array<struct<variable:string,impact:double,first_stage_f:double,first_stage_r2:double,weak:boolean>>"]))
    return table.select(series, "n", F.explode("xs").alias("x")).select(series, "x.*", "n")


def historical_decomposition(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int) -> DataFrame:
    """Per series, time, column and shock what the shock (orthogonal in order of ``columns``) has made of the column's value since the series' first modelled row; ``shock`` null is the rest: the start and the means.

    The parts add up to the value.  A task takes a series; rows are those with all lags."""
    k = len(columns)
    own = _residuals(df, series, time, columns, lags)
    now = _lags(df, series, time, columns, lags).select(F.col(series).alias("s__"), F.col("time__").alias("t__"), *[F.col(f"v{i}_0").alias(f"y{i}") for i in range(k)])
    rows = frame(df, {f"c{i}": c for i, c in enumerate(columns)}, [series], [time])
    means = rows.groupBy(F.col(series).alias("s2__")).agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)])
    both = own.join(now, F.col(series).eqNullSafe(F.col("s__")) & (F.col("time__") == F.col("t__"))).join(means, F.col(series).eqNullSafe(F.col("s2__"))).drop("s__", "t__", "s2__")
    kinds = dict(df.dtypes)

    def parts(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("time__")
        coef, root = np.array(t.coef.iloc[0]).reshape(k, -1)[:, 1:].reshape(k, lags, k), np.linalg.cholesky(np.array(t.sigma.iloc[0]).reshape(k, k))
        shocks = np.linalg.solve(root, t[[f"u{i}" for i in range(k)]].to_numpy().T).T
        made = np.zeros((len(t) + lags, k, k))  # time, column, shock; zeros before the first row
        for s in range(len(t)):
            made[s + lags] = root * shocks[s] + sum(coef[:, j] @ made[s + lags - 1 - j] for j in range(lags))
        made = made[lags:]
        values = t[[f"y{i}" for i in range(k)]].to_numpy()
        rest = values - made.sum(2) + t[[f"m{i}" for i in range(k)]].to_numpy()
        out = {"series": [], "time": [], "variable": [], "shock": [], "value": []}
        for i, c in enumerate(columns):
            for j, name in enumerate([*columns, None]):
                out["series"] += [t[series].iloc[0]] * len(t)
                out["time"] += list(t.time__)
                out["variable"] += [c] * len(t)
                out["shock"] += [name] * len(t)
                out["value"] += list(made[:, i, j] if name is not None else rest[:, i])
        return pd.DataFrame(out).rename(columns={"series": series, "time": time})

    return both.groupBy(series).applyInPandas(parts, f"`{series}` {kinds[series]}, `{time}` {kinds[time]}, variable string, shock string, value double")
