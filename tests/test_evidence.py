"""Estimators that SQL does not check, against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlake.operators import associations, discontinuity, experiments, propensity
from effectlake.operators.resampling import poisson_weight


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(31)
    n = 700
    x, z = rng.normal(size=(2, n))
    t = (rng.random(n) < 1 / (1 + np.exp(-0.7 * x))).astype(int)
    seen = (rng.random(n) < 0.7 + 0.2 * t).astype(int)
    y = np.round(2 * t + x + z + rng.normal(size=n), 1)
    df = spark.createDataFrame([(i, float(y[i]), int(t[i]), int(seen[i]), float(x[i]), float(z[i])) for i in range(n)], "id long, y double, t int, o int, x double, z double").cache()
    return df, y, t, seen, x, z


def lee(y, t, seen, w):
    y, t, seen = (np.repeat(v, w) for v in (y, t, seen))
    q = [seen[t == a].mean() for a in (0, 1)]
    arm = int(q[1] >= q[0])
    own = np.sort(y[(t == arm) & (seen == 1)])
    cut = int(np.floor(abs(q[1] - q[0]) / max(q) * len(own)))
    other = y[(t == 1 - arm) & (seen == 1)].mean()
    below, above = own[: len(own) - cut].mean(), own[cut:].mean()
    return (below - other, above - other) if arm else (other - above, other - below)


def test_lee_intervals(spark, rows):
    df, y, t, seen, *_ = rows
    r = experiments.lee_intervals(df, "y", "t", "o", "id", 25, seed=2).first()
    every = {b: [] for b in range(1, 26)}
    for q in spark.range(700).select("id", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("b")).select("id", "b", poisson_weight(2, "b", "id").alias("w")).orderBy("b", "id").collect():
        every[q.b].append(q.w)
    drawn = np.array([lee(y, t, seen, np.array(w)) for w in every.values()])
    assert np.allclose([r.lower, r.upper], lee(y, t, seen, np.ones(700, int)))
    assert np.allclose([r.se_lower, r.se_upper], drawn.std(0, ddof=1)) and np.allclose([r.ci_lower, r.ci_upper], [np.quantile(drawn[:, 0], 0.025), np.quantile(drawn[:, 1], 0.975)])
    inner = experiments.lee_intervals(df, "y", "t", "o", "id", 10, x="x", strata=3, seed=2).first()
    plain = experiments.lee_bounds_tightened(df, "y", "t", "o", "x", 3).first()
    assert (inner.lower, inner.upper) == (pytest.approx(plain.lower), pytest.approx(plain.upper)) and inner.ci_lower < inner.lower < inner.upper < inner.ci_upper


def test_orders_of_local_polynomials(rows):
    df, y, _, _, x, _ = rows
    got = {r.polynomial: r for r in discontinuity.order_sensitivity(df, "y", "x", 0.1, 1.2).collect()}
    for order in (0, 1, 2, 3):
        level, var = [], 0.0
        for side in (x >= 0.1, x < 0.1):
            r = x[side] - 0.1
            k = np.maximum(1 - np.abs(r) / 1.2, 0)
            a = r[:, None] ** np.arange(order + 1)
            inv = np.linalg.inv((a.T * k) @ a)
            b = inv @ (a.T * k) @ y[side]
            level.append(b[0])
            s = a * (k * (y[side] - a @ b))[:, None]
            var += (inv @ s.T @ s @ inv)[0, 0]
        assert got[order].estimate == pytest.approx(level[0] - level[1], rel=1e-6, abs=1e-9) and got[order].se == pytest.approx(np.sqrt(var), rel=1e-5)


def test_penalised_and_trimmed_propensities(rows):
    df, y, t, _, x, z = rows
    a = np.column_stack([np.ones(700), x, z])

    def logit(ridge):
        b = np.zeros(3)
        for _ in range(60):
            p = 1 / (1 + np.exp(-a @ b))
            b = b + np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag([0, ridge, ridge]), a.T @ (t - p) - np.array([0, ridge, ridge]) * b)
        return b

    table = propensity.model_table(df, "t", ["x", "z"], ridge=5.0).collect()
    assert np.allclose([r.estimate for r in table], logit(5.0), rtol=1e-6)
    p = 1 / (1 + np.exp(-a @ logit(0.0)))
    lo, hi = np.quantile(p, [0.05, 0.9])
    keep = (p >= lo) & (p <= hi)
    assert propensity.trimmed(propensity.with_propensity(df, "t", ["x", "z"]), (0.05, 0.9)).count() == keep.sum()
    r = propensity.ipw_observational(df, "y", "t", ["x", "z"], trim=(0.05, 0.9), stabilize=True).first()
    mean = lambda on, w: (w * y)[keep & on].sum() / w[keep & on].sum()
    assert r.estimate == pytest.approx(mean(t == 1, 1 / p) - mean(t == 0, 1 / (1 - p)), rel=1e-6) and r.n_trimmed == 700 - keep.sum()


def test_logistic_fluctuation(rows):
    df, _, t, _, x, z = rows
    q = 1 / (1 + np.exp(-0.3 * x))
    own = df.withColumns({"q": 1 / (1 + F.exp(-0.3 * F.col("x"))), "h": F.col("z")})
    e = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(np.log(q / (1 - q)) + e * z)))
        e += (z @ (t - p)) / (z**2 @ (p * (1 - p)))
    assert propensity.logistic_fluctuation(own, "t", "q", "h") == pytest.approx(e, abs=1e-8)


def test_selection_hazard(rows):
    df, _, t, *_ = rows
    got = associations.selection_hazard(df, "t", ["x"]).select("t", "x", "p_selected", "hazard").collect()
    # The probit's score is 0 at its solution.
    from statistics import NormalDist as N

    p = np.array([r.p_selected for r in got])
    eta = np.array([N().inv_cdf(v) for v in p])
    d = np.array([N().pdf(v) for v in eta])
    score = (np.array([r.t for r in got]) - p) * d / (p * (1 - p))
    assert abs(score.sum()) < 0.05 and abs(score @ np.array([r.x for r in got])) < 0.05 and np.allclose([r.hazard for r in got], d / (1 - p), rtol=1e-3)


def test_lee_intervals_deal_no_values_to_replicates(spark, monkeypatch, rows):
    """Only the ranges that a trimming cuts through are ranked: the same bounds, whatever the ranges, with ties and a stratum that lacks an arm."""
    df = rows[0].withColumns({"y": F.round("y", 1), "t": F.when(F.col("x") < -1.5, 1).otherwise(F.col("t"))})
    found = []
    for ranges in (4, 64):
        monkeypatch.setattr(experiments, "RANGES", ranges)
        found.append([tuple(experiments.lee_intervals(df, "y", "t", "o", "id", 10, x=x, strata=12, seed=2).first()) for x in (None, "x")])
    assert np.allclose(*found)
    plain, inner = experiments.lee_bounds(df, "y", "t", "o").first(), experiments.lee_bounds_tightened(df, "y", "t", "o", "x", 12).first()
    assert np.allclose([r[:2] for r in found[0]], [(plain.lower, plain.upper), (inner.lower, inner.upper)])
    empty = experiments.lee_intervals(df.limit(0), "y", "t", "o", "id", 5).first()
    assert empty.lower is None and empty.ci_upper is None and empty.replicates == 0
