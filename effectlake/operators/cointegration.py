"""Reduced-rank cointegration and error correction, per series.

A series is one Gram matrix of its lagged levels, lagged changes and present change.
Ranks, cointegrating vectors, the error-correction model and its errors are algebra of
that matrix: the error-correction terms are combinations of its columns, so no second
pass over the rows is needed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .moments import cross_products, each_row, frame, inferred, inverted, join_by, left_over, square, types
from .series import _lags

#: 5 % critical values of the trace and greatest-eigenvalue tests by number of further relations, 1 to 6 (MacKinnon, Haug and Michelis 1999), with a constant and with none.
TRACE = {True: (3.84, 15.49, 29.80, 47.86, 69.82, 95.75), False: (4.13, 12.32, 24.28, 40.17, 60.06, 83.94)}
GREATEST = {True: (3.84, 14.26, 21.13, 27.59, 33.88, 40.08), False: (4.13, 11.22, 17.80, 24.16, 30.44, 36.63)}


def _columns(k: int, lags: int) -> list[Column]:
    """Constant, last levels, lagged changes from the latest on, present changes."""
    v = lambda i, j: F.col(f"v{i}_{j}")
    return [F.lit(1.0), *[v(i, 1) for i in range(k)], *[v(i, j) - v(i, j + 1) for j in range(1, lags) for i in range(k)], *[v(i, 0) - v(i, 1) for i in range(k)]]


def _gram(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int) -> DataFrame:
    return cross_products(_lags(df, series, time, columns, lags), _columns(len(columns), lags), [series])


def reduced_rank(m: np.ndarray, n: int, k: int, lags: int, constant: bool) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, the greatest first, and their vectors of the levels: squared canonical correlations of changes and last levels, both freed of lagged changes and the constant."""
    given = [*([0] if constant else []), *range(1 + k, 1 + k * lags)]
    levels, now = [*range(1, 1 + k)], [*range(1 + k * lags, 1 + k * (lags + 1))]
    s = left_over(m, given, [*levels, *now]) / n if given else m[np.ix_([*levels, *now], [*levels, *now])] / n
    s11, s10, s00 = s[:k, :k], s[:k, k:], s[k:, k:]
    size = np.sqrt(np.diag(s11))
    root = np.linalg.inv(np.linalg.cholesky(s11 / np.outer(size, size))) / size  # root s11 root' = 1
    values, vectors = np.linalg.eigh(root @ s10 @ inverted(s00)[0] @ s10.T @ root.T)
    return np.clip(values[::-1], 0, 1 - 1e-12), (root.T @ vectors)[:, ::-1]


def rank_of(values: np.ndarray, n: int, constant: bool) -> tuple[int, list[float], list[float]]:
    """The first rank whose trace test is not rejected, the traces, and the greatest-eigenvalue statistics."""
    logs = -n * np.log(1 - values)
    trace = [float(logs[r:].sum()) for r in range(len(values))]
    rank = next((r for r, t in enumerate(trace) if t < TRACE[constant][len(values) - r - 1]), len(values))
    return rank, trace, logs.tolist()


def _refused(k: int, lags: int) -> None:
    if not 2 <= k <= len(TRACE[True]) or lags < 1:
        raise ValueError(f"2 to {len(TRACE[True])} columns and at least 1 lag")


def johansen_test(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, constant: bool = True) -> DataFrame:
    """Per series and r the eigenvalue, the trace statistic of at most r relations and the greatest-eigenvalue one, their 5 % critical values, whether the trace rejects, the series' rank and n.  ``lags`` are those of the model in levels.  Series too short have no row."""
    k = len(columns)
    _refused(k, lags)

    def test(r: dict) -> dict:
        n, xs = r["n"], []
        if n > k * (lags + 1) + 1:
            try:
                values, _ = reduced_rank(square(r["xx"], 1 + k * (lags + 1)), n, k, lags, constant)
                rank, trace, greatest = rank_of(values, n, constant)
                xs = [(i, float(values[i]), trace[i], TRACE[constant][k - i - 1], float(greatest[i]), GREATEST[constant][k - i - 1], trace[i] >= TRACE[constant][k - i - 1], rank) for i in range(k)]
            except np.linalg.LinAlgError:
                pass  # columns that others make up
        return {series: r[series], "n": n, "xs": xs}

    shape = "n long, xs array<struct<r:long,eigenvalue:double,trace:double,trace_critical:double,greatest:double,greatest_critical:double,rejected:boolean,rank:long>>"
    table = each_row(_gram(df, series, time, columns, lags), test, ", ".join([*types(df, [series]), shape]))
    return table.select(series, "n", F.explode("xs").alias("x")).select(series, "x.*", "n")


_MODEL = "n long, rank long, beta array<double>, coef array<double>, cov array<double>, sigma array<double>"


def _model(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, rank: int | None, constant: bool) -> DataFrame:
    """Per series the rank, beta (columns x rank, by rows, its first rows the unit matrix), the equations' coefficients (of error-correction terms, lagged changes, constant), the inverse of their products, sigma."""
    k = len(columns)
    _refused(k, lags)

    def fit(r: dict) -> dict:
        n, base = r["n"], {series: r[series], "n": r["n"], "rank": None, "beta": None, "coef": None, "cov": None, "sigma": None}
        if n <= k * (lags + 1) + 1:
            return base
        m = square(r["xx"], 1 + k * (lags + 1))
        try:
            values, vectors = reduced_rank(m, n, k, lags, constant)
            own = rank_of(values, n, constant)[0] if rank is None else rank
            beta = vectors[:, :own] @ np.linalg.inv(vectors[:own, :own]) if own else np.zeros((k, 0))
        except np.linalg.LinAlgError:
            return base
        p = own + k * (lags - 1) + int(constant)
        to = np.zeros((len(m), p))
        to[1 : 1 + k, :own] = beta
        to[1 + k : 1 + k * lags, own : own + k * (lags - 1)] = np.eye(k * (lags - 1))
        if constant:
            to[0, -1] = 1
        now = [*range(1 + k * lags, 1 + k * (lags + 1))]
        inverse, _ = inverted(to.T @ m @ to) if p else (np.zeros((0, 0)), None)
        coef = inverse @ to.T @ m[:, now]
        sigma = (m[np.ix_(now, now)] - coef.T @ to.T @ m[:, now]) / max(n - p, 1)
        return {**base, "rank": own, "beta": beta.ravel().tolist(), "coef": coef.T.ravel().tolist(), "cov": inverse.ravel().tolist(), "sigma": sigma.ravel().tolist()}

    return each_row(_gram(df, series, time, columns, lags), fit, ", ".join([*types(df, [series]), _MODEL]))


def error_correction(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, rank: int | None = None, constant: bool = True, alpha: float = 0.05) -> DataFrame:
    """Per series, equation (the column whose change it is) and term the coefficient of the error-correction model: estimate, se, p_value, interval, df, rank, n.

    Terms: error_1, error_2, ... (what the levels are off the relations that
    ``cointegrating_vectors`` gives), <column>_1, ... (changes of earlier rows),
    constant.  ``rank``, by default that of the trace test, is taken as known in the errors."""
    k = len(columns)

    def rows(r: dict) -> dict:
        xs = []
        if r["coef"] is not None:
            terms = [*[f"error_{j + 1}" for j in range(r["rank"])], *[f"{c}_{j}" for j in range(1, lags) for c in columns], *(["constant"] if constant else [])]
            p = len(terms)
            coef, cov, sigma = np.array(r["coef"]).reshape(k, p), np.array(r["cov"]).reshape(p, p), np.array(r["sigma"]).reshape(k, k)
            xs = [(columns[i], t, float(coef[i, j]), float(np.sqrt(max(sigma[i, i] * cov[j, j], 0))), r["n"] - p) for i in range(k) for j, t in enumerate(terms)]
        return {series: r[series], "rank": r["rank"], "n": r["n"], "xs": xs}

    table = each_row(_model(df, series, time, columns, lags, rank, constant), rows, ", ".join([*types(df, [series]), "rank long, n long, xs array<struct<equation:string,term:string,estimate:double,se:double,df:long>>"]))
    return inferred(table.select(series, "rank", "n", F.explode("xs").alias("x")).select(series, "x.*", "rank", "n"), alpha, "df")


def cointegrating_vectors(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, rank: int | None = None, constant: bool = True) -> DataFrame:
    """Per series, relation and column its weight; the first ``rank`` columns have the unit matrix."""
    k = len(columns)

    def rows(r: dict) -> dict:
        beta = np.array(r["beta"]).reshape(k, -1) if r["rank"] else np.zeros((k, 0))
        return {series: r[series], "xs": [(j + 1, columns[i], float(beta[i, j])) for j in range(beta.shape[1]) for i in range(k)]}

    table = each_row(_model(df, series, time, columns, lags, rank, constant), rows, ", ".join([*types(df, [series]), "xs array<struct<relation:long,variable:string,weight:double>>"]))
    return table.select(series, F.explode("xs").alias("x")).select(series, "x.*")


def error_correction_terms(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, rank: int | None = None, constant: bool = True) -> DataFrame:
    """df's rows with series, time and errors, an array of what the row's levels are off each relation (of levels less the series' means); empty without a relation."""
    k = len(columns)
    model = _model(df, series, time, columns, lags, rank, constant).select(series, "rank", "beta")
    rows = frame(df, {f"c{i}": c for i, c in enumerate(columns)}, [series], [time])
    means = rows.groupBy(series).agg(F.array(*[F.avg(f"c{i}") for i in range(k)]).alias("m"))
    both = join_by(rows, join_by(model, means, [series]), [series])
    off = F.transform(F.when(F.col("rank") > 0, F.sequence(F.lit(0), F.col("rank") - 1)).otherwise(F.array().cast("array<bigint>")), lambda j: sum(((F.col(f"c{i}") - F.col("m")[i]) * F.get("beta", (F.col("rank") * i + j).cast("int")) for i in range(k)), F.lit(0.0)))
    return both.where("rank IS NOT NULL").select(series, time, off.alias("errors"))


def error_correction_causality(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, rank: int | None = None, constant: bool = True) -> DataFrame:
    """Per series and ordered pair (cause, effect) the Wald test, by the chi-squared law, that the cause's lagged changes have no part in the effect's equation: statistic, df, p_value, n.  A model of one lag has none."""
    k = len(columns)

    def rows(r: dict) -> dict:
        xs = []
        if r["coef"] is not None and lags > 1:
            p = r["rank"] + k * (lags - 1) + int(constant)
            coef, cov, sigma = np.array(r["coef"]).reshape(k, p), np.array(r["cov"]).reshape(p, p), np.array(r["sigma"]).reshape(k, k)
            for c in range(k):
                at = [r["rank"] + k * j + c for j in range(lags - 1)]
                for e in range(k):
                    if c != e:
                        b, v = coef[e, at], sigma[e, e] * cov[np.ix_(at, at)]
                        w = float(b @ inverted(v)[0] @ b)
                        xs.append((columns[c], columns[e], w, len(at), stats.chi2_tail(w, len(at))))
        return {series: r[series], "n": r["n"], "xs": xs}

    table = each_row(_model(df, series, time, columns, lags, rank, constant), rows, ", ".join([*types(df, [series]), "n long, xs array<struct<cause:string,effect:string,statistic:double,df:long,p_value:double>>"]))
    return table.select(series, "n", F.explode("xs").alias("x")).select(series, "x.*", "n")


def error_correction_forecast(df: DataFrame, series: str, time: str, columns: Sequence[str], lags: int, steps: int, rank: int | None = None, constant: bool = True) -> DataFrame:
    """Per series, step and column the level that the model forecasts from the series' last ``lags`` rows on."""
    k = len(columns)
    model = _model(df, series, time, columns, lags, rank, constant).select(series, "rank", "beta", "coef")
    rows = frame(df, {f"c{i}": c for i, c in enumerate(columns)}, [series], [time])
    means = rows.groupBy(series).agg(F.array(*[F.avg(f"c{i}") for i in range(k)]).alias("m"))
    last = rows.withColumn("r__", F.row_number().over(Window.partitionBy(series).orderBy(F.col(time).desc()))).where(F.col("r__") <= lags)
    packed = last.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("r__", *[f"c{i}" for i in range(k)]))).alias("past"))  # ``lags`` rows

    def run(r: dict) -> dict:
        out = []
        if r["coef"] is not None and len(r["past"]) == lags:
            own, mean = r["rank"], np.array(r["m"])
            coef, beta = np.array(r["coef"]).reshape(k, -1), np.array(r["beta"]).reshape(k, own)
            past = [np.array([x[f"c{i}"] for i in range(k)]) - mean for x in r["past"]]  # the latest first
            for step in range(1, steps + 1):
                regressors = [beta.T @ past[0], *[past[j] - past[j + 1] for j in range(lags - 1)], *([[1.0]] if constant else [])]
                now = past[0] + coef @ np.concatenate(regressors)
                past = [now, *past[: lags - 1]]
                out += [(step, c, float(v)) for c, v in zip(columns, now + mean, strict=True)]
        return {series: r[series], "xs": out}

    table = each_row(join_by(join_by(packed, means, [series]), model, [series]), run, ", ".join([*types(df, [series]), "xs array<struct<step:long,variable:string,forecast:double>>"]))
    return table.select(series, F.explode("xs").alias("x")).select(series, "x.*")
