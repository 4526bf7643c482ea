"""Checks of kink designs against plain NumPy."""

import numpy as np

from effectlake.operators import discontinuity


def test_kink_checks(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, 3000)
    d, a, b = 2 * np.maximum(x, 0) + rng.normal(0, 0.1, 3000), x + rng.normal(0, 0.2, 3000), -3 * np.maximum(x, 0) + rng.normal(0, 0.2, 3000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, d, a, b, strict=True)], "x double, d double, a double, b double")
    got = {r.check: r for r in discontinuity.kink_checks(df, "d", ["a", "b"], "x", 0.0, 0.8, 10).collect()}
    assert {k: r.passed for k, r in got.items()} == {"first stage": True, "a": True, "b": False, "density": True}
    for name, y in (("first stage", d), ("a", a), ("b", b)):
        slopes, var = [], 0.0
        for side in (x < 0, x >= 0):
            w = np.where(side, np.maximum(1 - np.abs(x) / 0.8, 0), 0)
            X = np.column_stack([np.ones_like(x), x])
            inverse = np.linalg.inv(X.T @ (w[:, None] * X))
            beta = inverse @ X.T @ (w * y)
            slopes.append(beta[1])
            e = w * (y - X @ beta)
            var += (inverse @ (X.T * e**2) @ X @ inverse)[1, 1]
        assert np.allclose([got[name].estimate, got[name].se], [slopes[1] - slopes[0], np.sqrt(var)])
    near = x[np.abs(x) <= 0.8]
    counts, edges = np.histogram(near, 20, (-0.8, 0.8))
    centre = (edges[1:] + edges[:-1]) / 2
    X = np.column_stack([np.ones(20), centre, np.maximum(centre, 0)])
    hat = np.linalg.inv(X.T @ X) @ X.T / (len(near) * 0.08)
    assert np.allclose([got["density"].estimate, got["density"].se], [(hat @ counts)[2], np.sqrt((hat**2 @ counts)[2])])


def test_kink_density_sees_a_bend_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.uniform(-1, 0, 2000), rng.triangular(0, 0, 1, 2000)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (5.0,)], "x double")
    r = discontinuity.kink_density(df, "x", 0.0, 1.0).first()
    assert r.n == 4000 and r.estimate < 0 and r.p_value < 1e-6
    empty = discontinuity.kink_density(df.limit(0), "x", 0.0, 1.0).first()
    assert empty.n == 0 and empty.estimate is None and empty.p_value is None


def _kink(seed=12, n=900):
    rng = np.random.default_rng(seed)
    x = rng.normal(0.3, 2, n)
    return x, 1 + x + 0.3 * x**2 + 1.5 * np.maximum(x, 0) + rng.normal(0, 1, n)


def _ik(x, y, c):
    n, span = len(x), np.ptp(x)
    pilot = 1.06 * min(x.std(), np.subtract(*np.percentile(x, [75, 25])) / 1.34) * n**-0.2
    curves, spreads, near = [], [], []
    for side in (x < c, x >= c):
        fit = np.polyfit(x[side] - c, y[side], 2)
        curves.append(abs(2 * fit[0]))
        spreads.append((y[side] - np.polyval(fit, x[side] - c)).std())
        near.append((np.abs(x[side] - c) <= pilot).sum())
    h = 3.43 * np.mean(spreads) * n ** (-1 / 9) * (sum(near) / (2 * pilot * n) / np.mean(curves) ** 2) ** (1 / 9)
    return np.clip(h, span / 20, span / 2), pilot


def test_kink_bandwidths(spark):
    a, b = _kink(), _kink(13, 400)
    rows = [(s, float(u), float(v)) for s, (x, y) in (("a", a), ("b", b)) for u, v in zip(x, y, strict=True)] + [("a", None, 1.0), ("few", 1.0, 2.0), ("few", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    got = {r.s: r for r in discontinuity.kink_bandwidth(df, "y", "x", 0.0, by=["s"]).collect()}
    rule = {r.s: r for r in discontinuity.kink_bandwidth(df, "y", "x", 0.0, "rot", by=["s"]).collect()}
    for name, (x, y) in (("a", a), ("b", b)):
        h, pilot = _ik(x, y, 0.0)
        assert np.allclose([got[name].bandwidth, got[name].pilot], [h, pilot]) and got[name].n == len(x)
        assert np.isclose(rule[name].bandwidth, np.clip(pilot * len(x) ** (4 / 45), np.ptp(x) / 20, np.ptp(x) / 2))
    assert np.isclose(got["few"].bandwidth, 0.5)
    alone = discontinuity.kink_bandwidth(df.where("s = 'a'"), "y", "x", 0.0).first()
    assert np.isclose(alone.bandwidth, got["a"].bandwidth)
    far = discontinuity.kink_bandwidth(df.where("s = 'a'"), "y", "x", 50.0).first()
    assert np.isclose(far.bandwidth, 2 * far.pilot)
    empty = discontinuity.kink_bandwidth(df.limit(0), "y", "x", 0.0).first()
    assert empty.n == 0 and empty.bandwidth is None


def test_kink_cross_validation_leaves_out_each_row(spark):
    x, y = _kink(14, 150)
    df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    tried = [0.02, 1.0, 2.0, 4.0]
    got = {r.bandwidth: r for r in discontinuity.kink_cross_validation(df, "y", "x", 0.0, tried).collect()}
    for h in tried:
        errors = []
        for i in range(len(x)):
            rest = (np.arange(len(x)) != i) & ((x >= 0) == (x[i] >= 0))
            w = np.maximum(1 - np.abs(x[rest]) / h, 0)
            if (w > 0).sum() < 3:
                continue
            X = np.vander(x[rest], 3, increasing=True)
            b = np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * y[rest]))
            errors.append((y[i] - b @ [1, x[i], x[i] ** 2]) ** 2)
        assert got[h].n == len(errors)
        assert got[h].error is None if len(errors) < len(x) // 2 else np.isclose(got[h].error, np.mean(errors), rtol=1e-6)
    assert [h for h in tried if got[h].best] == [min((r.error, h) for h, r in got.items() if r.error is not None)[1]]
    own = discontinuity.kink_cross_validation(df, "y", "x", 0.0).collect()
    h = discontinuity.kink_bandwidth(df, "y", "x", 0.0).first().bandwidth
    assert np.allclose([r.bandwidth for r in own], np.linspace(h / 2, 2 * h, 10)) and sum(r.best for r in own) == 1
    assert discontinuity.kink_cross_validation(df.limit(0), "y", "x", 0.0).collect() == []
