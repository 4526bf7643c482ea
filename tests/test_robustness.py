"""Estimators on shifted, missing, empty and one-sided data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlake.operators import discontinuity, experiments, instruments, learners, moments, panels, propensity, ranks


@pytest.fixture(scope="module")
def trial(spark):
    rng = np.random.default_rng(8)
    n = 600
    x, z = rng.normal(size=(2, n))
    t = (rng.random(n) < 0.4 + 0.2 * (z > 0)).astype(int)
    y = 1 + 2.0 * t + x + rng.normal(size=n)
    rows = [(i, float(y[i]), int(t[i]), float(x[i]), float(z[i]), i % 25, "ab"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, t int, x double, z double, unit int, segment string").cache()


ESTIMATORS = {
    "regression": lambda d: experiments.regression_ate(d, "y", "t", ["x"]),
    "simple": lambda d: experiments.simple_ate(d, "y", "t"),
    "weighted": lambda d: experiments.hajek_ate(d, "y", "t", F.lit(0.4)),
    "tsls": lambda d: instruments.tsls(d, "y", "t", ["z"], ["x"], errors="HC0"),
    "two_way": lambda d: panels.twfe(d, "y", "t", "unit", "segment"),
    "double_ml": lambda d: learners.double_ml(d, "y", "t", ["x"], "id"),
    "tmle": lambda d: propensity.tmle(propensity.with_outcome_models(propensity.with_propensity(d, "t", ["x"]), "y", "t", ["x"]), "y", "t"),
    "rdd": lambda d: discontinuity.sharp_rdd(d, "y", "z", 0.0, 1.0),
}


@pytest.mark.parametrize("name", ESTIMATORS)
def test_large_offsets_cost_no_digits(trial, name):
    want = ESTIMATORS[name](trial).first()
    got = ESTIMATORS[name](trial.withColumns({"y": F.col("y") + 1e9, "x": F.col("x") + 1e6})).first()
    assert np.allclose([got.estimate, got.se, got.ci_lower, got.p_value], [want.estimate, want.se, want.ci_lower, want.p_value], rtol=2e-4, atol=1e-5) and want.se > 0


@pytest.mark.parametrize("name", ["regression", "simple", "weighted", "tsls", "two_way", "double_ml", "rdd"])
def test_rows_with_nulls_are_left_out(spark, trial, name):
    odd = spark.createDataFrame([(9000, None, 1, 0.5, 0.5, 3, "a"), (9001, float("nan"), 0, 0.5, 0.5, 3, "a"), (9002, float("inf"), 0, 0.5, 0.5, 3, "a")], trial.schema)
    want, got = ESTIMATORS[name](trial).first(), ESTIMATORS[name](trial.unionByName(odd)).first()
    assert np.allclose([got.estimate, got.se], [want.estimate, want.se], rtol=1e-9) and {k: got[k] for k in ("n", "df") if k in got} == {k: want[k] for k in ("n", "df") if k in want}


@pytest.mark.parametrize("name", ["regression", "simple", "weighted", "tsls", "rdd"])
def test_empty_input_gives_a_null_row(trial, name):
    rows = ESTIMATORS[name](trial.limit(0)).collect()
    assert all(r.estimate is None and r.ci_lower is None for r in rows)


def test_one_arm_alone(trial):
    ones = trial.where("t = 1")
    assert experiments.regression_ate(ones, "y", "t", ["x"]).first().estimate is None
    assert experiments.simple_ate(ones, "y", "t").first().estimate is None
    with pytest.raises(ValueError):
        propensity.with_outcome_models(ones, "y", "t", ["x"])
    with pytest.raises(ValueError):
        propensity.logit(ones, "t", ["x"])


@pytest.mark.parametrize("limit", [10_000, 0])
def test_segments_are_single_runs(trial, monkeypatch, limit):
    """Few segments go by the driver, many by tasks; either is what each gives by itself."""
    monkeypatch.setattr(moments, "LIMIT", limit)
    for f in (
        lambda d, by: experiments.regression_ate(d, "y", "t", ["x"], by), lambda d, by: instruments.tsls(d, "y", "t", ["z"], ["x"], by, errors="cluster", cluster="unit"),
        lambda d, by: experiments.simple_ate(d, "y", "t", by), lambda d, by: instruments.k_class(d, "y", "t", ["z"], ["x"], by=by), lambda d, by: discontinuity.sharp_rdd(d, "y", "z", 0.0, 1.0, by),
    ):
        both = {r.segment: r for r in f(trial, ["segment"]).collect()}
        for s in "ab":
            one = f(trial.where(F.col("segment") == s), []).first()
            assert np.allclose([both[s].estimate, both[s].se, both[s].p_value], [one.estimate, one.se, one.p_value], rtol=1e-6)


def test_requirements(spark, trial):
    experiments.require(trial, finite=["y"], binary=["t"], varied=["x"])
    for bad in (dict(binary=["x"]), dict(varied=["one"]), dict(finite=["gap"]), dict(within={"x": (0, 1)})):
        with pytest.raises(ValueError):
            experiments.require(trial.withColumns({"one": F.lit(1), "gap": F.when(F.col("id") > 3, 1.0)}), **bad)
    with pytest.raises(ValueError):
        experiments.require(trial.limit(0), finite=["y"])
    with pytest.raises(ValueError):
        panels.did_regression(trial.withColumn("post", (F.col("id") % 3 == 0).cast("int")), "y", "t", "post", "unit")


def test_running_counts_and_quantiles(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=400), np.repeat(1.5, 300), rng.lognormal(3, 3, 100), [-1e12, 1e15]])
    df = spark.createDataFrame([(float(x), "ab"[i % 2]) for i, x in enumerate(v)], "v double, g string")
    values = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k"))
    for r in ranks.running(values, "v", "k", ["g"]).collect():
        assert r.before == (v["ab".index(r.g) :: 2] < r.v).sum()
    taus = [0.0, 0.1, 0.5, 0.77, 1.0]
    for r in ranks.quantiles(df, "v", taus, ["g"]).collect():
        assert np.allclose(r.q, np.quantile(v["ab".index(r.g) :: 2], taus), rtol=1e-9)
    assert ranks.quantiles(df, "v", [0.3]).first().q == [pytest.approx(np.quantile(v, 0.3))]


def test_quantiles_by_brackets(spark, monkeypatch):
    """Segments of many rows, where only values within a sketch's brackets are ranked."""
    monkeypatch.setattr(ranks, "ACCURACY", 100)
    monkeypatch.setattr(ranks, "WINDOW", 1_000)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=6000), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    taus = [0.0, 0.01, 0.3, 0.5, 0.995, 1.0]
    assert np.allclose(ranks.quantiles(df, "v", taus).first().q, np.quantile(v, taus))


def test_quantiles_of_many_rows_of_few_values(spark, monkeypatch):
    """Large segments of few values need no sort of their rows; those of many values meet their brackets by broadcast."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 37).cast("double").alias("few"), (F.col("id") * 7919 % 20_011).cast("double").alias("many"))
    monkeypatch.setattr(ranks, "WINDOW", 1_000)
    monkeypatch.setattr(ranks, "ACCURACY", 100)
    taus, rows = [0.1, 0.5, 0.9], df.toPandas()
    for column in ("few", "many"):
        out = ranks.quantiles(df, column, taus, ["g"])
        assert all(np.allclose(r.q, np.quantile(rows[column][rows.g == r.g], taus)) for r in out.collect())
    plan = ranks.quantiles(df, "many", taus, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
