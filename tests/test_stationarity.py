"""Unit-root and stationarity tests against regressions on the rows themselves."""

import numpy as np
import pytest

from effectlake.operators import series as T
from effectlake.operators import stationarity as ST


def _series():
    rng = np.random.default_rng(11)
    noise = rng.normal(size=150)
    ar = np.zeros(97)
    for i in range(2, 97):
        ar[i] = 0.5 * ar[i - 1] - 0.3 * ar[i - 2] + rng.normal()
    return {"noise": noise + 1e6, "walk": np.cumsum(rng.normal(size=200)), "trend": 0.3 * np.arange(120) + rng.normal(size=120), "ar": ar, "short": rng.normal(size=11), "tiny": rng.normal(size=5), "flat": np.full(30, 4.0)}


def _frame(spark, series):
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows + [("noise", 1000, None), ("walk", 1001, float("nan"))], "s string, t long, x double")


def _design(x, lags, regression):
    d = np.diff(x)
    target = d[lags:]
    cols = [x[lags:-1], *[d[lags - i : len(d) - i] for i in range(1, lags + 1)]]
    if regression != "n":
        cols.append(np.ones(len(target)))
    if regression == "ct":
        cols.append(np.arange(len(target), dtype=float))
    return np.column_stack(cols), target


def _fit(x, lags, regression):
    shift = x.mean() if regression != "n" else 0.0
    X, y = _design(x - shift, lags, regression)
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    rss = ((y - X @ b) ** 2).sum()
    return b[0] / np.sqrt(rss / (len(y) - X.shape[1]) * np.linalg.inv(X.T @ X)[0, 0]), rss, *X.shape


@pytest.mark.parametrize("regression", ["n", "c", "ct"])
@pytest.mark.parametrize("criterion", ["aic", "bic", "fixed"])
def test_selected_lags_are_those_of_separate_regressions(spark, regression, criterion):
    data = _series()
    if regression == "n":
        data["noise"] = data["noise"] - 1e6
    got = {r.s: r for r in ST.unit_root_selected(_frame(spark, data), "s", "t", "x", regression, criterion).collect()}
    for name in ("noise", "walk", "trend", "ar", "short"):
        x = data[name]
        most = min(int(np.ceil(12 * (len(x) / 100) ** 0.25)), len(x) // 3 - 1)
        found = []
        for lags in [most] if criterion == "fixed" else range(most + 1):
            tau, rss, n, k = _fit(x, lags, regression)
            if n >= 5 and n > k:
                found.append((n * np.log(rss / n) + (2 if criterion == "aic" else np.log(n)) * k, lags, tau, n))
        _, lags, tau, n = min(found)
        assert (got[name].lags, got[name].n) == (lags, n), name
        assert np.isclose(got[name].statistic, tau, rtol=1e-6), name
    assert got["tiny"].statistic is None and got["flat"].statistic is None


def test_selected_lags_agree_with_the_test_of_given_lags(spark):
    df = _frame(spark, {k: v for k, v in _series().items() if k in ("walk", "ar")})
    for regression in ("n", "c", "ct"):
        a = {r.s: r for r in ST.unit_root_selected(df, "s", "t", "x", regression, "fixed", 3).collect()}
        b = {r.s: r for r in T.unit_root_test(df, "s", "t", "x", 3, regression).collect()}
        for k in b:
            assert np.isclose(a[k].statistic, b[k].statistic) and (a[k].n, a[k].stationary) == (b[k].n, b[k].stationary)


@pytest.mark.parametrize("regression", ["n", "c", "ct"])
def test_phillips_perron(spark, regression):
    data = _series()
    if regression == "n":
        data["noise"] = data["noise"] - 1e6
    got = {r.s: r for r in ST.phillips_perron(_frame(spark, data), "s", "t", "x", regression).collect()}
    for name in ("noise", "walk", "trend", "ar", "short"):
        x = data[name]
        bandwidth = int(np.ceil(4 * (len(x) / 100) ** 0.25))
        X, y = _design(x - (x.mean() if regression != "n" else 0.0), 0, regression)
        b = np.linalg.lstsq(X, y, rcond=None)[0]
        e, n = y - X @ b, len(y)
        short = e @ e / n
        long = short + sum(2 * (1 - j / (bandwidth + 1)) * (e[j:] @ e[:-j]) / n for j in range(1, bandwidth + 1))
        s2 = e @ e / (n - X.shape[1])
        se = np.sqrt(s2 * np.linalg.inv(X.T @ X)[0, 0])
        z = np.sqrt(short / long) * b[0] / se - 0.5 * (long - short) / np.sqrt(long) * n * se / np.sqrt(s2)
        rho = n * b[0] - 0.5 * n**2 * se**2 / s2 * (long - short)
        assert np.allclose([got[name].statistic, got[name].rho_statistic], [z, rho], rtol=1e-6), name
        assert got[name].n == n
    assert got["tiny"].statistic is None and got["flat"].statistic is None


@pytest.mark.parametrize("regression", ["c", "ct"])
def test_stationarity_around(spark, regression):
    data = _series()
    got = {r.s: r for r in ST.stationarity_around(_frame(spark, data), "s", "t", "x", regression).collect()}
    for name in ("noise", "walk", "trend", "ar", "short"):
        x = data[name] - data[name].mean()
        n = len(x)
        X = np.column_stack([np.ones(n), np.arange(n)])[:, : 1 + (regression == "ct")]
        e = x - X @ np.linalg.lstsq(X, x, rcond=None)[0]
        bandwidth = int(np.ceil(4 * (n / 100) ** 0.25))
        long = e @ e / n + sum(2 * (1 - j / (bandwidth + 1)) * (e[j:] @ e[:-j]) / n for j in range(1, bandwidth + 1))
        assert np.isclose(got[name].statistic, (np.cumsum(e) ** 2).sum() / n**2 / long, rtol=1e-6), name
    assert got["tiny"].statistic is None and got["flat"].statistic is None


def test_confirmed_stationarity(spark):
    data = _series() | {"long walk": np.cumsum(np.random.default_rng(3).normal(size=1500))}
    df = _frame(spark, data)
    got = {r.s: r for r in ST.confirmed_stationarity(df, "s", "t", "x").collect()}
    roots = {r.s: r for r in ST.unit_root_selected(df, "s", "t", "x").collect()}
    around = {r.s: r for r in ST.stationarity_around(df, "s", "t", "x", "c").collect()}
    says = {(True, True): "stationary", (False, False): "non-stationary", (True, False): "inconclusive", (False, True): "inconclusive"}
    assert got.keys() == data.keys()
    for k, r in got.items():
        assert (r.unit_root, r.lags, r.around) == (roots[k].statistic, roots[k].lags, around[k].statistic)
        assert r.conclusion == says.get((roots[k].stationary, around[k].stationary)) and (r.reason is None) == (r.conclusion is None)
    assert got["noise"].conclusion == "stationary" and got["long walk"].conclusion == "non-stationary" and got["tiny"].conclusion is None


def test_long_run_shocks(spark):
    rng = np.random.default_rng(8)
    v = np.zeros((300, 2))
    for i in range(2, 300):
        v[i] = [0.4 * v[i - 1, 0] + 0.2 * v[i - 1, 1], 0.3 * v[i - 1, 1] - 0.2 * v[i - 2, 0]] + rng.normal(size=2)
    walk = np.cumsum(rng.normal(size=300))
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(v)] + [("b", i, float(x * 1.02**i), float(x)) for i, x in enumerate(walk)]
    df = spark.createDataFrame(rows, "s string, t long, x double, y double")
    got = {(r.h, r.response, r.shock): r for r in T.impulse_responses(df, "s", "t", ["x", "y"], 2, 400, long_run=True).where("s = 'a'").collect()}
    total = {(i, j): sum(got[h, i, j].value for h in range(401)) for i in "xy" for j in "xy"}
    assert abs(total["x", "y"]) < 1e-9 and total["x", "x"] > 0 and total["y", "y"] > 0
    sigma = np.array(T.vector_autoregression(df, "s", "t", ["x", "y"], 2).where("s = 'a'").first().sigma).reshape(2, 2)
    impact = np.array([[got[0, i, j].value for j in "xy"] for i in "xy"])
    assert np.allclose(impact @ impact.T, sigma)
    assert np.isclose(got[5, "x", "x"].share + got[5, "x", "y"].share, 1)
    unstable = spark.createDataFrame([("u", i, float(1.1**i + rng.normal()), float(rng.normal())) for i in range(80)], "s string, t long, x double, y double")
    assert T.impulse_responses(unstable, "s", "t", ["x", "y"], 1, 3, long_run=True).count() == 0


def test_no_rows_give_none(spark):
    empty = spark.createDataFrame([], "s string, t long, x double")
    for f in (ST.unit_root_selected, ST.phillips_perron, ST.stationarity_around, ST.confirmed_stationarity):
        assert f(empty, "s", "t", "x").collect() == []
    with pytest.raises(ValueError):
        ST.unit_root_selected(empty, "s", "t", "x", "q")
