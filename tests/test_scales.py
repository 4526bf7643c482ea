"""Units of measurement and levels of segments make no difference."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlake.operators import associations, experiments, instruments, learners, panels, propensity, series


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 500
    x, z, u = rng.normal(size=(3, n))
    t = (rng.random(n) < 0.4 + 0.25 * (z > 0)).astype(int)
    d = 0.8 * z + 0.5 * x + u + rng.normal(size=n)
    y = 1 + 2.0 * t + d + x + u + rng.normal(size=n)
    made = [(i, float(y[i]), int(t[i]), float(d[i]), float(x[i]), float(z[i]), i % 25, "ab"[i % 2], i // 2) for i in range(n)]
    return spark.createDataFrame(made, "id long, y double, t int, d double, x double, z double, unit int, segment string, time long").cache()


def table(df, *keys):
    return sorted((tuple(r[k] for k in keys), [v for k, v in sorted(r.asDict().items()) if k not in keys]) for r in df.collect())


def same(a, b, rtol=1e-6, atol=1e-9):
    assert len(a) == len(b) > 0
    for (ka, va), (kb, vb) in zip(a, b, strict=True):
        flat = lambda vs: [x for v in vs for x in (v if isinstance(v, list) else [v])]
        va, vb = flat(va), flat(vb)
        assert ka == kb and [v is None for v in va] == [v is None for v in vb], (ka, va, vb)
        for p, q in zip(va, vb, strict=True):
            assert p == q if p is None or isinstance(p, str | bool) else np.isclose(p, q, rtol=rtol, atol=atol, equal_nan=True), (ka, va, vb)


SCALED = {
    "tsls": lambda d: instruments.tsls(d, "y", "d", ["z"], ["x"], errors="HC0"),
    "liml": lambda d: instruments.k_class(d, "y", "d", ["z", "t"], ["x"], fuller=1.0),
    "gmm": lambda d: instruments.gmm(d, "y", "d", ["z", "t"], ["x"]),
    "strength": lambda d: instruments.instrument_strength(d, "d", ["z", "t"], ["x"]),
    "anderson_rubin": lambda d: instruments.anderson_rubin(d, "y", "d", ["z", "t"], ["x"]),
    "likelihood_ratio": lambda d: instruments.conditional_likelihood_ratio(d, "y", "d", ["z", "t"], ["x"]),
    "control_function": lambda d: instruments.control_function(d, "y", "d", ["z"], ["x"]),
    "r_learner": lambda d: learners.effect_summary(learners.r_learner(propensity.with_propensity(d, "t", ["z"]), "y", "t", ["x"])),
    "a_learning": lambda d: learners.a_learning(d, "y", "t", ["x"]).where("term = 'treatment'"),
    "mediation": lambda d: associations.mediation_sensitivity(d.withColumn("m", F.col("x")), "y", "t", "m", [0.3]),
    "partial": lambda d: associations.partial_correlations(d, ["y", "d", "x"]),
}


@pytest.mark.parametrize("name", SCALED)
@pytest.mark.parametrize("factor", [1e8, 1e-8])
def test_a_control_in_another_unit(rows, name, factor):
    want, got = SCALED[name](rows), SCALED[name](rows.withColumn("x", F.col("x") * factor))
    keys = [c for c in ("term", "a", "b", "rho") if c in want.columns and name in ("a_learning", "partial", "mediation")]
    same(table(want, *keys), table(got, *keys))


SERIES = {
    "granger": (lambda d: series.granger(d, "segment", "time", ["y", "x"], 2), ("segment", "cause", "effect")),
    "lags": (lambda d: series.select_lags(d, "segment", "time", ["y", "x"], 3), ("segment",)),
    "unit_root": (lambda d: series.unit_root_test(d, "segment", "time", "x", 2), ("segment",)),
    "projections": (lambda d: series.local_projections(d.withColumn("s", F.col("x") / F.col("unit_of_x")), "segment", "time", "y", "s", 1, 2), ("segment", "h")),
    "cointegration": (lambda d: series.cointegration_test(d, "segment", "time", "y", ["x"], 1), ("segment",)),
}


@pytest.mark.parametrize("name", SERIES)
def test_a_series_in_another_unit(rows, name):
    f, keys = SERIES[name]
    want = table(f(rows.withColumn("unit_of_x", F.lit(1.0))), *keys)
    for factor in (1e8, 1e-8):
        same(want, table(f(rows.withColumns({"x": F.col("x") * factor, "unit_of_x": F.lit(factor)})), *keys))


def test_a_control_that_others_make_up(rows):
    own = rows.withColumn("twice", 2 * F.col("x"))
    same(table(SCALED["tsls"](rows).select("estimate")), table(instruments.tsls(own, "y", "d", ["z"], ["x", "twice"], errors="HC0").select("estimate")))
    keys = ("estimate", "se")
    same(table(experiments.regression_ate(rows, "y", "t", ["x"]).select(*keys)), table(experiments.regression_ate(own, "y", "t", ["x", "twice"]).select(*keys)), rtol=2e-3)
    gap = lambda d, xs: learners.effect_summary(learners.t_learner(d, "y", "t", xs)).select("estimate", "spread", "least")
    same(table(gap(rows, ["x"])), table(gap(own, ["x", "twice"])))
    none = instruments.tsls(own, "y", "twice", ["z"], ["x"]).first()
    assert none.estimate is None and none.se is None


SEGMENTS = {
    "regression": lambda d, by: experiments.regression_ate(d, "y", "t", ["x"], by),
    "did": lambda d, by: panels.did_regression(d.withColumn("post", (F.col("time") > 100).cast("int")).withColumn("t", (F.col("unit") % 3 == 0).cast("int")), "y", "t", "post", "unit", by),
    "trends": lambda d, by: panels.parallel_trends(d.withColumn("t", (F.col("unit") % 3 == 0).cast("int")), "y", "t", "time", "unit", by),
    "tsls": lambda d, by: instruments.tsls(d, "y", "d", ["z"], ["x"], by, errors="cluster", cluster="unit"),
    "liml": lambda d, by: instruments.k_class(d, "y", "d", ["z"], ["x"], by=by),
    "strength": lambda d, by: instruments.instrument_strength(d, "d", ["z"], ["x"], by),
    "anderson_rubin": lambda d, by: instruments.anderson_rubin(d, "y", "d", ["z"], ["x"], by=by),
    "cace": lambda d, by: instruments.cace(d.withColumn("b", (F.col("unit") % 2).cast("int")), "y", "t", "b", ["x"], by).drop("compliers", "always", "never"),
    "baron_kenny": lambda d, by: associations.baron_kenny(d, "y", "t", "d", ["x"], by),
    "partial": lambda d, by: associations.partial_correlations(d, ["y", "d", "x"], by=by),
    "conjugate": lambda d, by: associations.conjugate_effect(d, "y", "t", ["x"], by=by),
}


@pytest.mark.parametrize("name", SEGMENTS)
def test_each_segment_on_its_own_level(rows, name):
    """Segment b is 1e9 up in every continuous column, and gives what it gives alone and at its old level."""
    f, keys = SEGMENTS[name], [c for c in ("a", "b") if name == "partial"]
    up = {c: F.col(c) + F.when(F.col("segment") == "b", 1e9).otherwise(0.0) for c in ("y", "d", "x", "z")}
    both = f(rows.withColumns(up), ["segment"])
    for s in "ab":
        want = table(f(rows.where(F.col("segment") == s), []), *keys)
        same(want, table(both.where(F.col("segment") == s).drop("segment"), *keys), rtol=3e-5, atol=1e-7)


def test_robust_series_errors_on_other_levels(rows):
    want = table(panels.hac_ols(rows, "y", ["x"], "segment", "time", 3).where("term = 'x'"), "segment")
    up = {c: F.col(c) + F.when(F.col("segment") == "b", 1e9).otherwise(0.0) for c in ("y", "x")}
    same(want, table(panels.hac_ols(rows.withColumns(up), "y", ["x"], "segment", "time", 3).where("term = 'x'"), "segment"), rtol=3e-5)


def test_all_cells_or_an_error(spark, monkeypatch):
    made = [(u, p, float(u + p + (2 if g and p >= g else 0)), g) for u in range(12) for p in range(6) for g in [(None, 2, 4)[u % 3]]]
    panel = spark.createDataFrame(made, "u long, p long, y double, g long")
    effects, total = panels.sun_abraham(panel, "y", "u", "p", "g")
    assert effects.count() == 6 and total.first().estimate == pytest.approx(2)
    none, total = panels.sun_abraham(panel.limit(0), "y", "u", "p", "g")
    assert none.count() == 0 and total.first().estimate is None
    monkeypatch.setattr(panels, "CELLS", 5)
    with pytest.raises(ValueError):
        panels.sun_abraham(panel, "y", "u", "p", "g")


def test_nothing_is_left_in_storage(rows):
    before = len(rows.sparkSession.sparkContext._jsc.getPersistentRDDs())
    r = propensity.permutation_test(rows, "y", "t", "id", 20).first()
    assert r.replicates == 20 and len(rows.sparkSession.sparkContext._jsc.getPersistentRDDs()) == before


def test_empty_input_has_null_rows(rows):
    none = rows.limit(0)
    assert all(r.estimate is None and r.n == 0 for r in learners.rif_effects(none, "y", "t", [0.2, 0.5]).collect())
    assert all(r.estimate is None for r in panels.event_study(none, "y", "t", "unit", "time", 3, 2, 2).collect())
    steps, value = learners.q_learning(none, [("t", ["x"])], "y")
    assert all(r.estimate is None for r in steps.collect()) and value.first().estimate is None
