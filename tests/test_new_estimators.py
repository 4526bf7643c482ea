"""Regression quantiles, local marginal effects and dynamic effects against plain NumPy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlake.operators import cointegration, dynamic, learners, marginal_effects, propensity, quantile_regression, ranks
from effectlake.operators.resampling import poisson_weight


def best_vertex(x, y, tau):
    """The linear programme's optimum, by trying every vertex."""
    loss = lambda b: ((e := y - x @ b) * (tau - (e < 0))).sum()
    found = [np.linalg.solve(x[list(c)], y[list(c)]) for c in itertools.combinations(range(len(y)), x.shape[1]) if abs(np.linalg.det(x[list(c)])) > 1e-9]
    return min(found, key=loss)


def test_quantile_regression_is_the_linear_programme(spark):
    rng = np.random.default_rng(0)
    n = 61
    t, x = rng.integers(0, 2, n), rng.normal(50, 1e-3, n)
    y = 5 + 2 * t + 900 * (x - 50) + rng.standard_t(3, n)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(y, t, x, strict=True)], "y double, t int, x double")
    got = quantile_regression.quantile_regression(df, "y", ["t", "x"], [0.25, 0.5]).collect()
    design = np.column_stack([np.ones(n), t, x - 50])
    for tau in (0.25, 0.5):
        want = best_vertex(design, y, tau)
        own = {r.term: r for r in got if r.tau == tau}
        found = np.array([own["intercept"].estimate + 50 * own["x"].estimate, own["t"].estimate, own["x"].estimate])
        loss = lambda b: ((e := y - design @ b) * (tau - (e < 0))).sum()  # noqa: B023, E731
        assert loss(found) == pytest.approx(loss(want), rel=1e-9)
        assert own["t"].exact


def test_quantile_regression_of_many_copies(spark, monkeypatch):
    """Copies of a row count as one vertex, and bands that lose the optimum are widened: the optimum is proven."""
    rng = np.random.default_rng(5)
    n = 90
    t, x = rng.integers(0, 2, n), rng.normal(size=n)
    y = 1 + t - 2 * x + rng.standard_t(3, n)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(y, t, x, strict=True)] * 40, "y double, t int, x double")
    design = np.column_stack([np.ones(n), t, x])
    for band in (100_000, 10):
        monkeypatch.setattr(quantile_regression, "BAND", band)
        for tau in (0.3, 0.77):
            got = quantile_regression.quantile_regression(df, "y", ["t", "x"], [tau]).collect()
            assert all(r.exact and r.rounds < 40 and r.n == 40 * n for r in got)
            assert np.allclose([r.estimate for r in got], best_vertex(design, y, tau))
    r = quantile_regression.conditional_quantile_effects(df, "y", "t", [], [0.37]).first()
    assert r.exact and r.estimate == pytest.approx(np.subtract(*[np.quantile(y[t == a], 0.37, method="inverted_cdf") for a in (1, 0)]))


def test_quantile_regression_errors(spark):
    rng = np.random.default_rng(2)
    n, tau = 3_000, 0.7
    t = rng.integers(0, 2, n)
    y = 1 + 0.5 * t + rng.normal(size=n) * (1 + 0.3 * t)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(y, t, strict=True)], "y double, t int")
    r = quantile_regression.conditional_quantile_effects(df, "y", "t", [], [tau]).first()
    gap = np.quantile(y[t == 1], tau, method="inverted_cdf") - np.quantile(y[t == 0], tau, method="inverted_cdf")
    assert r.estimate == pytest.approx(gap, abs=2e-3)
    x, e = np.column_stack([np.ones(n), t]), None
    b = np.linalg.lstsq(np.column_stack([np.ones(n), t]), np.zeros(n), rcond=None)[0]
    b[0] = np.quantile(y[t == 0], tau, method="inverted_cdf")
    e = y - b[0] - r.estimate * t
    from statistics import NormalDist as N

    z = N().inv_cdf(tau)
    share = n ** (-1 / 3) * N().inv_cdf(0.975) ** (2 / 3) * (1.5 * N().pdf(z) ** 2 / (2 * z * z + 1)) ** (1 / 3)
    h = min(y.std(), (np.quantile(e, 0.75) - np.quantile(e, 0.25)) / 1.34) * (N().inv_cdf(tau + share) - N().inv_cdf(tau - share))
    f0 = np.maximum(0.75 * (1 - (e / h) ** 2), 0).mean() / h
    inv = np.linalg.inv(x.T @ x)
    d = np.where(e > 0, tau / f0, (1 - tau) / f0) ** 2
    assert r.se == pytest.approx(np.sqrt((inv @ (x.T * d) @ x @ inv)[1, 1]), rel=0.02)
    none = quantile_regression.conditional_quantile_effects(df.limit(0), "y", "t", [], [tau]).first()
    assert none.estimate is None and none.n == 0


def test_local_iv_is_the_direct_regression(spark):
    rng = np.random.default_rng(3)
    n = 1_500
    z, x, u = rng.normal(size=(3, n))
    d = (z + 0.3 * x + u > 0).astype(int)
    y = 100 + d * (2 - u) + 0.5 * x + 0.2 * rng.normal(size=n)
    df = spark.createDataFrame([(i, float(y[i]), int(d[i]), float(z[i]), float(x[i])) for i in range(n)], "id long, y double, d int, z double, x double")
    got = marginal_effects.local_iv(df, "y", "d", ["z"], ["x"], "id", replicates=8, points=20).orderBy("u").collect()
    b = propensity.logit(df, "d", ["z", "x"])
    p = 1 / (1 + np.exp(-(b[0] + b[1] * z + b[2] * x)))
    lo, hi = np.quantile(p, [0.01, 0.99])
    keep = (p >= lo) & (p <= hi)
    p, y, x = p[keep], y[keep], x[keep]
    line = np.column_stack([np.ones(len(x)), x])
    y = y - line @ np.linalg.lstsq(line, y, rcond=None)[0]
    h = max(1.06 * min(p.std(ddof=1), (np.quantile(p, 0.75) - np.quantile(p, 0.25)) / 1.34) * len(p) ** -0.2, 0.01)
    slopes = []
    for g in np.linspace(lo, hi, 20):
        w = np.maximum(0.75 * (1 - ((p - g) / h) ** 2), 0)
        a = np.column_stack([np.ones(len(p)), p - g])
        slopes.append(np.linalg.solve((a.T * w) @ a, (a.T * w) @ y)[1])
    want = marginal_effects.smoothed(np.array(slopes))
    assert np.allclose([r.u for r in got], np.linspace(lo, hi, 20)) and np.allclose([r.mte for r in got], want, rtol=1e-5, atol=1e-6)
    assert all(r.se > 0 and r.ci_lower < r.mte < r.ci_upper for r in got) and got[0].n == len(p)
    flat = np.array([1.0, 1, 1, np.nan, 1, 1])
    assert np.isnan(marginal_effects.smoothed(flat)[3]) and np.allclose(marginal_effects.smoothed(flat)[[0, 4]], 1)


def test_policy_effects(spark):
    curve = spark.createDataFrame([(0.2, 3.0), (0.5, 2.0), (0.8, 1.0)], "u double, mte double")
    rows = spark.createDataFrame([(0.9, 0.9, 1), (0.3, 0.6, 0), (0.6, 0.6, 1), (0.1, 0.6, 0)], "p double, q double, d int")
    r = marginal_effects.policy_effects(curve, rows, "p", "q", "d").first()
    att = np.array([2, 2, 1.0])
    atu = np.array([1, 2, 2.0])
    gain = np.array([1, 2, 0.0])
    m = np.array([3, 2, 1.0])
    assert np.allclose([r.ate, r.att, r.atu, r.prte], [2, *[(w * m).sum() / w.sum() for w in (att, atu, gain)]])


def plain_dynamic(y, d, x, lags, folds, how, ridge):
    """Row by row: lagged design, ridge residuals, backward recursion."""
    rows = np.arange(lags, len(y))
    t, yy, s = np.stack([d[rows - h] for h in range(lags + 1)], 1).astype(float), y[rows] - y[rows].mean(), x[rows] - x[rows].mean(0)
    n, block = len(rows), len(rows) // folds
    fold = np.minimum(np.arange(n) // block, folds - 1)
    thetas, sizes, psi = [], [], np.full((n, lags + 1), np.nan)
    for f in range(folds):
        train, test = (fold < f if how != "blocked" else fold != f), fold == f
        if not train.any():
            continue
        design = np.column_stack([np.ones(n), s])
        pen = np.diag([0.0, *[ridge] * s.shape[1]])
        fit = lambda v: design @ np.linalg.solve(design[train].T @ design[train] + pen, design[train].T @ v[train])  # noqa: E731, B023
        left, theta = yy.copy(), np.zeros(lags + 1)
        for h in range(lags, -1, -1):
            ry, rt = left - fit(left), t[:, h] - fit(t[:, h])
            v = (rt[train] ** 2).mean()
            theta[h] = (ry[train] * rt[train]).mean() / v
            psi[test, h] = ((ry - theta[h] * rt) * rt / v)[test]
            left = left - theta[h] * t[:, h]
        thetas.append(theta)
        sizes.append(test.sum())
    psi = psi[np.isfinite(psi).all(1)]
    psi = psi - psi.mean(0)
    most = 2
    var = (psi**2).sum(0) + 2 * sum((1 - j / (most + 1)) * (psi[j:] * psi[:-j]).sum(0) for j in range(1, most + 1))
    return np.average(thetas, axis=0, weights=sizes), np.sqrt(var) / len(psi)


@pytest.mark.parametrize("how", ["blocked", "rolling"])
def test_dynamic_effects_two_lags(spark, how):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 2))
    d = (0.4 * x[:, 0] + rng.normal(size=n) > 0).astype(int)
    y = 7 + 2 * d + np.r_[0, d[:-1]] + 0.5 * np.r_[0, 0, d[:-2]] + x @ [1, 0.5] + rng.normal(size=n)
    df = spark.createDataFrame([(1, i, float(y[i]), int(d[i]), *map(float, x[i])) for i in range(n)], "unit long, t long, y double, d int, a double, b double")
    got = dynamic.dynamic_effects(df, "y", "d", ["a", "b"], "unit", "t", 2, 4, how, bandwidth=2).collect()
    theta, se = plain_dynamic(y, d, x, 2, 4, how, 1.0)
    each = [r for r in got if r.lag is not None]
    assert np.allclose([r.estimate for r in each], theta, rtol=1e-6) and np.allclose([r.se for r in each], se, rtol=1e-6)
    whole = next(r for r in got if r.lag is None)
    assert whole.estimate == pytest.approx((theta * 0.99 ** np.arange(3)).sum()) and abs(theta[0] - 2) < 0.4


def test_dynamic_effects_by_unit(spark):
    rng = np.random.default_rng(6)
    made = []
    for u in range(60):
        x = rng.normal(size=15)
        d = (x + rng.normal(size=15) > 0).astype(int)
        y = d + 0.5 * np.r_[0, d[:-1]] + x + rng.normal(size=15)
        made += [(u, i, float(y[i]), int(d[i]), float(x[i])) for i in range(15)]
    df = spark.createDataFrame(made, "unit long, t long, y double, d int, a double")
    got = {r.lag: r for r in dynamic.dynamic_effects(df, "y", "d", ["a"], "unit", "t", 1, 5, "panel").collect()}
    assert abs(got[0].estimate - 1) < 4 * got[0].se and abs(got[1].estimate - 0.5) < 4 * got[1].se and got[0].n == 60 * 14
    assert all(r.estimate is None for r in dynamic.dynamic_effects(df.limit(0), "y", "d", ["a"], "unit", "t", 1).collect())


def test_panel_quantile_gaps(spark):
    rng = np.random.default_rng(9)
    made = [(u, int(u % 2), float(np.round(rng.normal() * 3 + (u % 2), 1))) for u in range(60) for _ in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame(made, "unit long, d int, y double")
    taus = [0.3, 0.5, 0.9]
    got = learners.panel_quantile_gaps(df, "y", "d", "unit", taus, 30, seed=4).collect()
    weights = {(r.b, r.unit): r.w for r in spark.range(60).selectExpr("id AS unit").crossJoin(spark.range(1, 31).selectExpr("int(id) AS b")).select("unit", "b", poisson_weight(4, "b", "unit").alias("w")).collect()}
    gap = lambda w, tau: np.quantile(np.concatenate([[y] * w(u) for u, d, y in made if d]), tau) - np.quantile(np.concatenate([[y] * w(u) for u, d, y in made if not d]), tau)
    for r, tau in zip(got, taus, strict=True):
        drawn = [gap(lambda u, b=b: weights[b, u], tau) for b in range(1, 31)]
        assert r.estimate == pytest.approx(gap(lambda u: 1, tau)) and r.se == pytest.approx(np.std(drawn, ddof=1))
        assert np.allclose([r.ci_lower, r.ci_upper], np.quantile(drawn, [0.025, 0.975])) and r.n_units == 60
    assert all(r.estimate is None for r in learners.panel_quantile_gaps(df.where("d = 1"), "y", "d", "unit", taus).collect())


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(12)
    n, out, made = 300, {}, []
    for s, related in (("a", True), ("b", False)):
        walk = np.cumsum(rng.normal(size=n))
        x = walk + rng.normal(size=n) * 0.5
        z = np.cumsum(rng.normal(size=n))
        y = 0.5 * walk + rng.normal(size=n) * 0.5 if related else np.cumsum(rng.normal(size=n))
        out[s] = np.column_stack([1e6 + x * 1e3, y, z])
        made += [(s, i, *map(float, out[s][i])) for i in range(n)]
    return spark.createDataFrame(made, "series string, t long, x double, y double, z double").cache(), out


def design(v, lags):
    d = np.diff(v, axis=0)
    t = np.arange(lags, len(v))
    return v[t - 1], np.column_stack([np.zeros((len(t), 0)), *[d[t - 1 - j] for j in range(1, lags)], np.ones(len(t))]), d[t - 1]


def test_reduced_rank(walks):
    df, data = walks
    got = cointegration.johansen_test(df, "series", "t", ["x", "y", "z"], 2).collect()
    for s, v in data.items():
        level, given, now = design(v - v.mean(0), 2)
        level, now = level / level.std(0), now / now.std(0)
        free = lambda a: a - given @ np.linalg.lstsq(given, a, rcond=None)[0]  # noqa: E731, B023
        r0, r1 = free(now), free(level)
        values = np.sort(np.linalg.eigvals(np.linalg.solve(r1.T @ r1, r1.T @ r0) @ np.linalg.solve(r0.T @ r0, r0.T @ r1)).real)[::-1]
        own = sorted((r for r in got if r.series == s), key=lambda r: r.r)
        assert np.allclose([r.eigenvalue for r in own], values, rtol=1e-6) and np.allclose([r.trace for r in own], [-len(now) * np.log(1 - values[i:]).sum() for i in range(3)], rtol=1e-6)
        assert own[0].n == len(now) and own[0].trace_critical == 29.80
    assert {r.series: r.rank for r in got} == {"a": 1, "b": 0}


def test_error_correction(walks):
    df, data = walks
    got = cointegration.error_correction(df, "series", "t", ["x", "y", "z"], 2, rank=1).where("series = 'a'").collect()
    beta = {r.variable: r.weight for r in cointegration.cointegrating_vectors(df, "series", "t", ["x", "y", "z"], 2, rank=1).where("series = 'a'").collect()}
    assert beta["x"] == pytest.approx(1) and beta["y"] == pytest.approx(-2000, rel=0.1)
    v = data["a"] - data["a"].mean(0)
    level, given, now = design(v, 2)
    ect = level @ [beta["x"], beta["y"], beta["z"]]
    x = np.column_stack([ect, given])
    inv = np.linalg.inv((x / np.abs(x).max(0)).T @ (x / np.abs(x).max(0))) / np.outer(np.abs(x).max(0), np.abs(x).max(0))
    b = inv @ x.T @ now
    e = now - x @ b
    se = np.sqrt(np.outer(np.diag(inv), (e**2).sum(0) / (len(x) - x.shape[1])))
    names = ["error_1", "x_1", "y_1", "z_1", "constant"]
    for r in got:
        i, j = names.index(r.term), ["x", "y", "z"].index(r.equation)
        assert r.estimate == pytest.approx(b[i, j], rel=1e-5, abs=1e-9) and r.se == pytest.approx(se[i, j], rel=1e-5)
    terms = cointegration.error_correction_terms(df, "series", "t", ["x", "y", "z"], 2, rank=1).where("series = 'a'").orderBy("t").collect()
    assert np.allclose([r.errors[0] for r in terms], v @ [beta["x"], beta["y"], beta["z"]], rtol=1e-6, atol=1e-4)
    ahead = {(r.step, r.variable): r.forecast for r in cointegration.error_correction_forecast(df, "series", "t", ["x", "y", "z"], 2, 3, rank=1).where("series = 'a'").collect()}
    past = [v[-1], v[-2]]
    for step in (1, 2, 3):
        new = past[0] + np.concatenate([[past[0] @ [beta["x"], beta["y"], beta["z"]]], past[0] - past[1], [1.0]]) @ b
        past = [new, past[0]]
        assert np.allclose([ahead[step, c] for c in "xyz"], new + data["a"].mean(0), rtol=1e-6)
    wald = {(r.cause, r.effect): r for r in cointegration.error_correction_causality(df, "series", "t", ["x", "y", "z"], 2, rank=1).where("series = 'a'").collect()}
    assert wald["z", "y"].statistic == pytest.approx((b[3, 1] / se[3, 1]) ** 2, rel=1e-5) and len(wald) == 6
    with pytest.raises(ValueError):
        cointegration.johansen_test(df, "series", "t", ["x"], 2)
    assert cointegration.johansen_test(df.limit(4), "series", "t", ["x", "y"], 2).count() == 0


def test_places_by_halving(spark):
    ends = [-1.0, 0.0, 0.5, 2.0]
    df = spark.createDataFrame([(v,) for v in (-2.0, -1.0, 0.2, 0.5, 2.0, 3.0, None)], "v double")
    for below, side in ((False, "right"), (True, "left")):
        for r in df.select("v", ranks.place(F.col("v"), ends, below).alias("k")).collect():
            assert r.k == (0 if r.v is None else np.searchsorted(ends, r.v, side))


def test_panel_quantile_gaps_widen_their_brackets(spark, monkeypatch):
    """Brackets that units of one size justify are too narrow where a unit is a lump: the same results as from all rows."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(u % 400 if u < 2_000 else -(u % 3)), int(u % 2), float(v)) for u, v in enumerate(rng.normal(size=4_000))], "unit int, d int, y double")
    df = df.withColumn("y", F.col("y") + F.when(F.col("unit") < 0, F.col("unit") * 2).otherwise(0))
    got = [tuple(r) for r in learners.panel_quantile_gaps(df, "y", "d", "unit", [0.25, 0.5], 20).collect()]
    monkeypatch.setattr(learners, "SLACKS", (1.0,))
    assert np.allclose(got, [tuple(r) for r in learners.panel_quantile_gaps(df, "y", "d", "unit", [0.25, 0.5], 20).collect()])
