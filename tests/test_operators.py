import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlake.functions import stats
from effectlake.operators import discontinuity, experiments, learners, matching, moments, panels


@pytest.fixture(scope="module")
def trial(spark):
    rng = np.random.default_rng(3)
    n = 2000
    x = rng.normal(size=n)
    t = rng.integers(0, 2, n)
    y = 1 + 2.0 * t + x + rng.normal(size=n)
    rows = [(i, float(y[i]), int(t[i]), float(x[i]), int(rng.integers(0, 5))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, t int, x double, unit int").cache(), y, t, x


def test_known_answer(spark):
    df = spark.createDataFrame([(7.0, 1), (5.0, 1), (3.0, 0), (1.0, 0)], "y double, t int")
    r = experiments.simple_ate(df, "y", "t").first()
    assert (r.estimate, r.n_treated) == (4.0, 2) and math.isclose(r.se, math.sqrt(2)) and math.isclose(r.df, 2.0)


def test_regression_against_numpy(trial):
    df, y, t, x = trial
    fit = moments.ols(df, F.col("y"), [F.col("t").cast("double"), F.col("x")], robust="HC3")
    X = np.column_stack([np.ones(len(y)), t, x])
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ y
    e = (y - X @ beta) / (1 - np.einsum("ij,jk,ik->i", X, inv, X))
    cov = inv @ (X.T * e**2) @ X @ inv
    assert np.allclose(fit["beta"], beta) and np.allclose(fit["se"], np.sqrt(np.diag(cov)))


def test_double_ml_recovers_the_effect(trial):
    r = learners.double_ml(trial[0], "y", "t", ["x"], "id").first()
    assert abs(r.estimate - 2) < 4 * r.se


def test_nearest_match_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 2)), float(np.round(rng.uniform(0, 20), 1))) for i in range(300)]
    got = {r.treated_id: (r.control_id, round(r.distance, 9)) for r in matching.nearest_match(spark.createDataFrame(rows, "id long, t int, s double"), "id", "t", "s", 0.35).collect()}
    want = {}
    for i, t, s in rows:
        near = sorted((round(abs(s - b), 9), b, j) for j, u, b in rows if u == 0 and abs(s - b) <= 0.35)
        if t == 1 and near:
            want[i] = (near[0][2], near[0][0])
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and got.keys() == want.keys()


def test_within_transform_equals_dummies(spark):
    rng = np.random.default_rng(1)
    rows = [(u, p, float(rng.normal() + u), float(rng.normal() + p)) for u in range(6) for p in range(5)]
    got = panels.twfe(spark.createDataFrame(rows, "u int, p int, y double, d double"), "y", "d", "u", "p").first().estimate
    X = np.array([[r[3], *(float(r[0] == k) for k in range(6)), *(float(r[1] == k) for k in range(1, 5))] for r in rows])
    assert math.isclose(got, np.linalg.lstsq(X, np.array([r[2] for r in rows]), rcond=None)[0][0], rel_tol=1e-9)


def test_fuzzy_rdd_recovers_the_effect(spark):
    rows = [(x / 10, int((x % 4 == 0) or x >= 0 and x % 2 == 0)) for x in range(-400, 400)]
    df = spark.createDataFrame([(x, d, 1 + 0.5 * x + 3.0 * d) for x, d in rows], "x double, d int, y double")
    r = discontinuity.fuzzy_rdd(df, "y", "d", "x", 0.0, 20.0).first()
    assert math.isclose(r.estimate, 3.0, rel_tol=1e-9) and 0.2 < r.first_stage < 0.3
    none = discontinuity.fuzzy_rdd(df.withColumn("d", F.lit(1)), "y", "d", "x", 0.0, 20.0).first()
    assert none.estimate is None


def test_lee_bounds_trim(spark):
    rows = [(1, 1, float(k)) for k in range(10)] + [(0, 1, float(k)) for k in range(5)] + [(0, 0, None)] * 5
    r = experiments.lee_bounds(spark.createDataFrame(rows, "t int, observed int, y double"), "y", "t", "observed").first()
    assert r.n_trimmed == 5 and r.lower == 2.0 - 2.0 and r.upper == 7.0 - 2.0


def test_distributions():
    assert math.isclose(stats.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-9)
    assert math.isclose(stats.t_quantile(0.975, 10), 2.2281388519649385, rel_tol=1e-7)
    assert math.isclose(stats.f_tail(4.0, 2, 20), 0.0346, abs_tol=2e-4)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
