import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlake.operators import learners, matching, panels, propensity


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 2000
    x = rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-0.5 * x))).astype(int)
    y = 1 + x + t * (2 + 0.5 * x) + rng.normal(size=n)
    rows = [(i, float(y[i]), int(t[i]), float(x[i]), i % 40, i % 7) for i in range(n)]
    return propensity.with_propensity(spark.createDataFrame(rows, "id long, y double, t int, x double, unit int, time int"), "t", ["x"]).cache(), y, t, x


@pytest.mark.parametrize("learner", [learners.s_learner, learners.t_learner, learners.x_learner, learners.r_learner])
def test_learners_find_the_effect(data, learner):
    got = {r.id: r.cate for r in learner(data[0], "y", "t", ["x"]).select("id", "cate").collect()}
    assert np.abs(np.array([got[i] for i in range(2000)]) - (2 + 0.5 * data[3])).mean() < 0.15


def test_t_learner_against_numpy(data):
    df, y, t, x = data
    fit = [np.polyfit(x[t == a], y[t == a], 1) for a in (0, 1)]
    want = np.polyval(fit[1], x) - np.polyval(fit[0], x)
    got = {r.id: r.cate for r in learners.t_learner(df, "y", "t", ["x"]).select("id", "cate").collect()}
    assert np.allclose([got[i] for i in range(2000)], want)


def test_rif_against_numpy(data):
    df, y, t, x = data
    q = np.quantile(y, 0.5)
    h = 1.06 * min(y.std(ddof=1), np.subtract(*np.quantile(y, [0.75, 0.25])) / 1.34) * len(y) ** -0.2
    f = np.exp(-(((y - q) / h) ** 2) / 2).mean() / h / np.sqrt(2 * np.pi)
    rif = q + (0.5 - (y <= q)) / f
    want = np.linalg.lstsq(np.column_stack([np.ones(len(y)), t, x]), rif, rcond=None)[0][1]
    r = learners.rif_effects(df, "y", "t", [0.5], ["x"]).first()
    assert np.allclose([r.quantile, r.density, r.estimate], [q, f, want])


def test_parallel_trends_against_numpy(data):
    df, y, t, _ = data
    n, time, unit = len(y), np.arange(len(y)) % 7, np.arange(len(y)) % 40
    X = np.column_stack([np.ones(n), t, time, t * time])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    s = np.array([(X * (y - X @ b)[:, None])[unit == u].sum(axis=0) for u in range(40)])
    se = np.sqrt((inv @ s.T @ s @ inv)[3, 3] * 40 / 39 * (n - 1) / (n - 4))
    r = panels.parallel_trends(df, "y", "t", "time", "unit").first()
    assert np.allclose([r.estimate, r.se], [b[3], se]) and r.n_clusters == 40 and 0 <= r.p_value <= 1


def test_unit_means_keep_rows_without_a_unit(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 6.0)], "unit int, y double")
    assert sorted(r.y_bar for r in panels.unit_means(df, ["y"], "unit").collect()) == [3.0, 3.0, 6.0]


def test_matched_effect(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 1.0), (4, 3.0)], "id long, y double")
    pairs = spark.createDataFrame([(1, 3), (1, 4), (2, 4)], "treated_id long, control_id long")
    r = matching.matched_effect(df, pairs, "id", "y").first()
    assert (r.estimate, r.n_matched) == (3.5, 2) and np.isclose(r.se, np.sqrt(0.5 / 2))


def test_effect_summary_by_segment(data):
    rows = learners.effect_summary(learners.t_learner(data[0], "y", "t", ["x"]), ["unit"])
    assert rows.agg(F.sum("n")).first()[0] == 2000
