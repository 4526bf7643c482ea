"""Panels, discontinuities, matching, selection, series and synthetic controls against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlake.functions import stats
from effectlake.operators import associations, discontinuity, instruments, learners, matching, panels, resampling, series, synthetic


def lstsq(X, y, groups=None, extra=0):
    inv = np.linalg.pinv(X.T @ X)
    b = inv @ X.T @ y
    e = y - X @ b
    if groups is None:
        meat = (X.T * e**2) @ X
        return b, inv @ meat @ inv
    s = np.array([(X * e[:, None])[groups == g].sum(0) for g in np.unique(groups)])
    g, n = len(s), len(y)
    return b, g / (g - 1) * (n - 1) / (n - np.linalg.matrix_rank(X)) * inv @ s.T @ s @ inv


@pytest.fixture(scope="module")
def panel(spark):
    """Unbalanced: a fifth of the unit-periods is missing, some are there twice."""
    rng = np.random.default_rng(2)
    rows = []
    for u in range(30):
        first = {0: 4, 1: 6}.get(u % 3)
        for p in range(9):
            for _ in range(0 if rng.random() < 0.2 else 1 + (rng.random() < 0.1)):
                rows.append((u, p, float(u + 0.3 * p + (2.5 if first is not None and p >= first else 0) + rng.normal()), float(first is not None and p >= first), first, int(first is not None)))
    cols = [np.array([r[k] for r in rows], float) for k in (0, 1, 2, 3)]
    return spark.createDataFrame(rows, "u int, p int, y double, d double, first int, ever int").cache(), *cols, np.array([-1 if r[4] is None else r[4] for r in rows])


def dummies(u, p):
    return np.column_stack([(u[:, None] == np.unique(u)).astype(float), (p[:, None] == np.unique(p)[1:]).astype(float)])


def test_two_way_effects_off_balance(panel):
    df, u, p, y, d, _ = panel
    b, cov = lstsq(np.column_stack([d, dummies(u, p)]), y, u)
    r = panels.twfe(df, "y", "d", "u", "p").first()
    assert np.allclose([r.estimate, r.se], [b[0], cov[0, 0] ** 0.5]) and r.df == 29


def test_event_study_and_sun_abraham(panel):
    df, u, p, y, _, first = panel
    ks = [-3, -2, 0, 1, 2]
    X = np.column_stack([*[((first >= 0) & (p - 4 == k)).astype(float) for k in ks], dummies(u, p)])
    b, cov = lstsq(X, y, u)
    got = {r.event_time: r for r in panels.event_study(df, "y", "ever", "u", "p", 4, 3, 3).collect()}
    assert np.allclose([[got[k].estimate, got[k].se] for k in ks], np.column_stack([b[:5], np.diag(cov)[:5] ** 0.5]))
    wald = b[:2] @ np.linalg.inv(cov[:2, :2]) @ b[:2]
    assert np.isclose(got[0].pretrend_p, stats.chi2_tail(float(wald), 2))
    cells = sorted({(f, q - f) for f, q in zip(first, p, strict=True) if f >= 0 and q >= f})
    X = np.column_stack([*[((first == g) & (p - first == k)).astype(float) for g, k in cells], dummies(u, p)])
    b, cov = lstsq(X, y, u)
    each, total = panels.sun_abraham(df, "y", "u", "p", "first")
    assert np.allclose([r.estimate for r in each.orderBy("cohort", "event_time").collect()], b[: len(cells)])
    w = np.array([((first == g) & (p - first == k)).sum() for g, k in cells], float)
    w /= w.sum()
    r = total.first()
    assert np.allclose([r.estimate, r.se], [w @ b[: len(w)], (w @ cov[: len(w), : len(w)] @ w) ** 0.5])


def test_wild_bootstrap_is_near_the_clustered_error(panel):
    df, u, p, y, d, _ = panel
    b, cov = lstsq(np.column_stack([np.ones(len(y)), d, p]), y, u)
    r = panels.wild_bootstrap(df, "y", ["d", "p"], 1, "u", 600).first()
    assert np.isclose(r.estimate, b[1]) and 0.7 < r.se / cov[1, 1] ** 0.5 < 1.3
    again = panels.wild_bootstrap(df.repartition(7), "y", ["d", "p"], 1, "u", 600).first()
    assert np.isclose(again.se, r.se) and again.p_bootstrap == r.p_bootstrap


def test_group_time_bootstrap(panel):
    balanced = panel[0].groupBy("u", "p").agg(F.avg("y").alias("y"), F.max("first").alias("first"))
    cells = panels.group_time_effects(balanced, "y", "u", "p", "first")
    boot = panels.group_time_bootstrap(balanced, "y", "u", "p", "first", 60).first()
    assert np.isclose(boot.estimate, panels.aggregate_effects(cells, "simple").first().att) and boot.ci_lower < 2.5 < boot.ci_upper and boot.replicates > 50
    never = panels.group_time_effects(balanced, "y", "u", "p", "first", "never")
    assert never.agg(F.max("n_control")).first()[0] <= 10


def test_bootstrap_means_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y double, t int")
    got = {r.replicate: r.estimate for r in resampling.bootstrap_means(df, "y", "t", "id", 5).collect()}
    again = {r.replicate: r.estimate for r in resampling.bootstrap_means(df.repartition(9), "y", "t", "id", 5).collect()}
    weights = {(r.b, r.id): r.w for r in df.select("id", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("b")).select("id", "b", resampling.poisson_weight(0, "b", "id").alias("w")).collect()}
    assert 0.9 < np.mean(list(weights.values())) < 1.1 and 0.8 < np.var(list(weights.values())) < 1.2
    for b in range(6):
        w = np.array([1 if b == 0 else weights[b, i] for i, _, _ in rows])
        y, t = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        assert np.isclose(got[b], np.average(y[t == 1], weights=w[t == 1]) - np.average(y[t == 0], weights=w[t == 0])) and np.isclose(got[b], again[b])


@pytest.fixture(scope="module")
def cut(spark):
    rng = np.random.default_rng(6)
    n = 900
    x = rng.uniform(-3, 3, n)
    d = (rng.random(n) < 0.2 + 0.6 * (x >= 0)).astype(float)
    y = 1 + 0.5 * x + 0.3 * x**2 + 2 * d + rng.normal(size=n)
    return spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, d, y, strict=True)], "x double, d double, y double").cache(), x, d, y


def one_side(x, y, on, h, order):
    w = np.maximum(1 - np.abs(x) / h, 0) * on
    X = np.vander(x, order + 1, increasing=True)
    inv = np.linalg.inv((X.T * w) @ X)
    b = inv @ (X.T * w) @ y
    return b, inv @ (X.T * (w * (y - X @ b)) ** 2) @ X @ inv, int((w > 0).sum())


def jump(x, y, h, order, at=0):
    (b1, v1, _), (b0, v0, _) = one_side(x, y, x >= 0, h, order), one_side(x, y, x < 0, h, order)
    return b1[at] - b0[at], (v1 + v0)[at, at]


def test_discontinuities(cut):
    df, x, d, y = cut
    for order in (0, 1, 2):
        r = discontinuity.sharp_rdd(df, "y", "x", 0.0, 1.5, order=order).first()
        est, var = jump(x, y, 1.5, order)
        assert np.allclose([r.estimate, r.se], [est, var**0.5])
    r = discontinuity.sharp_rdd(df, "y", "x", 0.0, 1.0, bias_bandwidth=2.0).first()
    bias = jump(x, y, 2.0, 2)[0] - jump(x, y, 2.0, 1)[0]
    assert np.allclose([r.estimate, r.se], [jump(x, y, 1.0, 1)[0] - bias, (jump(x, y, 1.0, 1)[1] + 0.25 * jump(x, y, 2.0, 1)[1]) ** 0.5])
    r = discontinuity.fuzzy_rdd(df, "y", "d", "x", 0.0, 1.5).first()
    late = jump(x, y, 1.5, 1)[0] / jump(x, d, 1.5, 1)[0]
    assert np.allclose([r.estimate, r.se], [late, jump(x, y - late * d, 1.5, 1)[1] ** 0.5 / abs(jump(x, d, 1.5, 1)[0])])
    r = discontinuity.sharp_kink(df, "y", "x", 0.0, 2.0, 1.5).first()
    est, var = jump(x, y, 2.0, 2, 1)
    assert np.allclose([r.estimate, r.se], [est / 1.5, var**0.5 / 1.5])
    r = discontinuity.fuzzy_kink(df, "y", "d", "x", 0.0, 2.0).first()
    ratio = jump(x, y, 2.0, 2, 1)[0] / jump(x, d, 2.0, 2, 1)[0]
    assert np.allclose([r.estimate, r.se], [ratio, jump(x, y - ratio * d, 2.0, 2, 1)[1] ** 0.5 / abs(jump(x, d, 2.0, 2, 1)[0])])
    rows = {r.bandwidth: r.estimate for r in discontinuity.bandwidth_sensitivity(df, "y", "x", 0.0, 1.0).collect()}
    assert np.allclose([rows[h] for h in (0.5, 2.0)], [jump(x, y, h, 1)[0] for h in (0.5, 2.0)])
    far = np.abs(x) >= 0.2
    assert np.isclose(discontinuity.donut_rdd(df, "y", "x", 0.0, 1.0, [0.2]).first().estimate, jump(x[far], y[far], 1.0, 1)[0])


def test_bandwidths(cut):
    df, x, _, y = cut
    sides = [x < 0, x >= 0]
    m2 = np.mean([2 * np.polyfit(x[s], y[s], 3)[-3] for s in sides])
    var = []
    for s in sides:
        near = s & (np.abs(x) <= 1)
        b = one_side(x[near], y[near], np.ones(near.sum(), bool), 1.0, 1)[0]
        var.append(s.sum() * np.var(y[near] - b[0] - b[1] * x[near]))
    h = np.clip(3.43754 * (sum(var) / len(x) / (len(x) * m2**2)) ** 0.2, 0.1 * x.std(), 2 * x.std())
    r = discontinuity.optimal_bandwidth(df, "y", "x", 0.0).first()
    assert np.allclose([r.bandwidth, r.bias_bandwidth], [h, 1.5 * h])
    got = {r.bandwidth: r for r in discontinuity.cross_validation_bandwidth(df, "y", "x", 0.0, [0.5, 1.0]).collect()}
    for h in (0.5, 1.0):
        e = []
        for s in sides:
            for i in np.flatnonzero(s & (np.abs(x) < h)):
                rest = s.copy()
                rest[i] = False
                b = one_side(x, y, rest, h, 1)[0]
                e.append((y[i] - b[0] - b[1] * x[i]) ** 2)
        assert np.isclose(got[h].error, np.mean(e)) and got[h].n == len(e)
    assert sum(r.best for r in got.values()) == 1


def test_density_and_bunching(spark, cut):
    r = discontinuity.density_test(cut[0], "x", 0.0).first()
    assert r.p_value > 0.01 and (r.n_left, r.n_right) == ((cut[1] < 0).sum(), (cut[1] >= 0).sum())
    pile = spark.createDataFrame([(float(v),) for v in np.concatenate([np.linspace(-50, 50, 5001), np.full(300, 0.1), np.full(7, 900.0)])], "x double")
    assert discontinuity.density_test(pile.where("x < 100"), "x", 0.0, bandwidth=20.0).first().theta > 0
    b = discontinuity.bunching(pile, "x", 0.0, 1.0, 2, within=(-45, 44), rates=(0.1, 0.2), replicates=100).first()
    assert abs(b.excess - 300) < 5 and abs(b.mass - 6) < 0.2 and b.n_outside == 7 + 5001 - 4500 and np.isclose(b.elasticity, b.mass / np.log(0.9 / 0.8)) and b.ci_lower < b.mass < b.ci_upper
    with pytest.raises(ValueError):
        discontinuity.bunching(spark.createDataFrame([(0.0,), (1e12,)], "x double"), "x", 0.0, 1.0, 2)


def test_matches(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.random() < 0.4), float(np.round(rng.uniform(0, 12), 1)), float(rng.normal())) for i in range(260)]
    df = spark.createDataFrame(rows, "id long, t int, s double, y double")
    want = {}
    for i, t, s, _ in rows:
        if t:
            near = sorted((round(abs(s - b), 9), b, j) for j, u, b, _ in rows if not u and abs(s - b) <= 0.35 + 1e-12)[:3]
            want |= {(i, k + 1): (c[2], c[0]) for k, c in enumerate(near)}
    got = {(r.treated_id, r.match): (r.control_id, round(r.distance, 9)) for r in matching.nearest_match(df, "id", "t", "s", 0.35, 3).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    used, once = set(), {}
    for i, t, s, _ in rows:
        near = sorted((abs(s - b), b, j) for j, u, b, _ in rows if t and not u and j not in used and abs(s - b) <= 0.05)
        if near:
            once[i] = near[0][2]
            used.add(near[0][2])
    got = {r.treated_id: r.control_id for r in matching.match_without_replacement(df, "id", "t", "s", 0.05).collect()}
    assert got == once
    pairs = matching.nearest_match(df, "id", "t", "s", 0.35)
    ys, link = {r[0]: r[3] for r in rows}, [(r.treated_id, r.control_id) for r in pairs.collect()]
    gaps = np.array([ys[a] - ys[b] for a, b in link])
    v0 = sum((ys[c] - np.mean([ys[a] for a, b in link if b == c])) ** 2 for c in {b for _, b in link})
    r = matching.matching_variance(df, pairs, "id", "t", "y").first()
    assert np.allclose([r.estimate, r.se], [gaps.mean(), np.sqrt(((gaps**2).mean() + v0 / sum(1 - x[1] for x in rows)) / len(gaps))])
    b = matching.matched_balance(df, pairs, "id", "t", ["s"]).first()
    assert abs(b.smd_after) < 0.1 and b.balanced and matching.psm_ate(df, "y", "t", ["s"], "id", 0.05).count() == 1


def test_selection_model(spark):
    rng = np.random.default_rng(4)
    n = 3000
    z, x, u = rng.normal(size=(3, n))
    s = (0.3 + z + 0.5 * x + u > 0).astype(int)
    y = 1 + 2 * x + 0.7 * u + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b), int(c), float(d) if c else None) for a, b, c, d in zip(z, x, s, y, strict=True)], "z double, x double, s int, y double")
    got = {r.term: r for r in associations.heckman(df, "y", "s", ["z", "x"], ["x"]).collect()}
    assert abs(got["x"].estimate - 2) < 0.15 and abs(got["lambda"].estimate - 0.7) < 0.3 and got["lambda"].p_value < 0.05
    from math import erf

    cdf = np.vectorize(lambda v: 0.5 * (1 + erf(v / 2**0.5)))
    W, g = np.column_stack([np.ones(n), z, x]), np.zeros(3)
    for _ in range(30):
        eta = W @ g
        p, f = cdf(eta), np.exp(-(eta**2) / 2) / np.sqrt(2 * np.pi)
        w = f**2 / (p * (1 - p))
        g = g + np.linalg.solve((W.T * w) @ W, W.T @ (w * (s - p) / f))
    on, eta = s == 1, W @ g
    mills = np.exp(-(eta**2) / 2) / np.sqrt(2 * np.pi) / cdf(eta)
    X = np.column_stack([np.ones(n), x, mills])[on]
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y[on]
    delta = (mills * (mills + eta))[on]
    s2 = ((y[on] - X @ b) ** 2).mean() + delta.mean() * b[2] ** 2
    cov = s2 * inv + b[2] ** 2 * inv @ (X.T * delta) @ X @ inv
    assert np.allclose([got[k].estimate for k in ("intercept", "x", "lambda")], b, atol=1e-4) and np.allclose([got[k].se for k in ("intercept", "x", "lambda")], np.diag(cov) ** 0.5, rtol=1e-3)


def test_instruments_robust_and_clustered(spark):
    rng = np.random.default_rng(12)
    n = 700
    z, x, u = rng.normal(size=(3, n))
    g = np.arange(n) % 35
    d = z + 0.5 * x + u + rng.normal(size=n)
    y = 1 + 2 * d + x + u + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(e), int(k)) for a, b, c, e, k in zip(z, x, d, y, g, strict=True)], "z double, x double, d double, y double, g int")
    first = np.column_stack([np.ones(n), x, z])
    hat = first @ np.linalg.lstsq(first, d, rcond=None)[0]
    second = np.column_stack([np.ones(n), x, hat])
    b, cov = lstsq(second, y)
    r = instruments.tsls(df, "y", "d", ["z"], ["x"], errors="HC0").first()
    assert np.allclose([r.estimate, r.se], [b[2], cov[2, 2] ** 0.5])
    r = instruments.tsls(df, "y", "d", ["z"], ["x"], errors="cluster", cluster="g").first()
    assert np.allclose([r.se, r.df], [lstsq(second, y, g)[1][2, 2] ** 0.5, 34])
    e, inv = y - np.column_stack([np.ones(n), x, d]) @ b, np.linalg.inv(second.T @ second)
    r = instruments.tsls(df, "y", "d", ["z"], ["x"], errors="HC1", structural=True).first()
    assert np.isclose(r.se, (n / (n - 3) * inv @ (second.T * e**2) @ second @ inv)[2, 2] ** 0.5)
    assert np.isclose(instruments.conditional_likelihood_ratio(df, "y", "d", ["z"], ["x"], 2.0).first().lr, instruments.anderson_rubin(df.withColumn("y", F.col("y") - 2 * F.col("d")), "y", "d", ["z"], ["x"]).first().statistic, rtol=1e-2)
    draws = np.random.default_rng(0).normal(size=(2, 200_000, 3))
    tt = np.array([3.0, 0.0, 0.0])  # T fixed, so q_t is 9
    qs, qst = (draws[0] ** 2).sum(1), draws[0] @ tt
    lr = 0.5 * (qs - 9 + np.sqrt((qs + 9) ** 2 - 4 * (qs * 9 - qst**2)))
    assert abs(instruments.clr_tail(4.0, 9.0, 3) - (lr > 4).mean()) < 0.005


def test_double_machine_learning(spark):
    rng = np.random.default_rng(3)
    n = 1000
    x, u = rng.normal(size=(2, n))
    unit = np.arange(n) % 50
    d = 0.5 * x + u
    y = 1 + 1.5 * d + x + rng.normal(size=n)
    t = (d > 0).astype(int)
    df = spark.createDataFrame([(i, float(x[i]), float(d[i]), float(y[i]), int(t[i]), int(unit[i])) for i in range(n)], "id long, x double, d double, y double, t int, unit int")
    X, fold = np.column_stack([np.ones(n), x]), np.arange(n) % 4
    fit = lambda v, on: X @ np.linalg.lstsq(X[on], v[on], rcond=None)[0]
    out = lambda v, on=np.ones(n, bool): np.choose(fold, [fit(v, (fold != k) & on) for k in range(4)])
    rd, ry = d - out(d), y - out(y)
    theta = (rd * ry).sum() / (rd**2).sum()
    psi = rd * (ry - theta * rd) / (rd**2).mean()
    rows = {r.fold: r for r in learners.double_ml_continuous(df, "y", "d", ["x"], F.col("id") % 4, 4).collect()}
    assert np.allclose([rows[None].estimate, rows[None].se], [theta, np.sqrt(psi.var(ddof=1) / n)]) and len(rows) == 5
    e, g1, g0 = np.clip(out(t.astype(float)), 0.025, 0.975), out(y, t == 1), out(y, t == 0)
    s = g1 - g0 + t * (y - g1) / e - (1 - t) * (y - g0) / (1 - e)
    r = learners.interactive_dml(df, "y", "t", ["x"], F.col("id") % 4, 4).first()
    assert np.allclose([r.estimate, r.se], [s.mean(), np.sqrt(s.var(ddof=1) / n)])
    r = learners.panel_double_ml(df, "y", "d", ["x"], "unit").first()
    assert abs(r.estimate - 1.5) < 4 * r.se and r.n_units == 50
    q, value = learners.q_learning(df, [("t", ["x"])], "y")
    W = np.column_stack([np.ones(n), x, t, t * x])
    b, cov = lstsq(W, y)
    got = {r.term: r for r in q.collect()}
    assert np.allclose([got["treatment"].estimate, got["treatment*x"].se], [b[2], cov[3, 3] ** 0.5])
    assert np.isclose(value.first().estimate, (b[0] + b[1] * x + np.maximum(b[2] + b[3] * x, 0)).mean())
    assert {r.term for r in learners.a_learning(df, "y", "t", ["x"]).collect()} == {"treatment", "treatment*x"}


def test_series(spark):
    rng = np.random.default_rng(5)
    rows, kept = [], {}
    for s in "ab":
        v = np.zeros((120, 2))
        for k in range(1, 120):
            v[k] = [0.5 * v[k - 1, 0] + 0.4 * v[k - 1, 1], 0.3 * v[k - 1, 1]] + rng.normal(size=2)
        kept[s] = v + 100
        rows += [(s, k, float(a), float(b)) for k, (a, b) in enumerate(kept[s])]
    df = spark.createDataFrame(rows, "s string, k int, a double, b double")
    for r in series.vector_autoregression(df, "s", "k", ["a", "b"], 2).collect():
        v = kept[r.s]
        X = np.column_stack([np.ones(118), v[1:-1], v[:-2]])
        b = np.linalg.lstsq(X, v[2:], rcond=None)[0]
        e = v[2:] - X @ b
        assert np.allclose(np.array(r.coef).reshape(2, 5)[:, 1:], b.T[:, 1:]) and np.allclose(np.array(r.sigma).reshape(2, 2), e.T @ e / (118 - 5))
        like = -118 / 2 * (2 * np.log(2 * np.pi) + np.log(np.linalg.det(e.T @ e / 118)) + 2)
        assert np.allclose([r.aic, r.bic], [-2 * like + 20, -2 * like + 10 * np.log(118)])
    for r in series.granger(df, "s", "k", ["a", "b"], 2).where("cause = 'b'").collect():
        v = kept[r.s]
        rss = lambda X: ((v[2:, 0] - X @ np.linalg.lstsq(X, v[2:, 0], rcond=None)[0]) ** 2).sum()  # noqa: E731, B023
        small, full = np.column_stack([np.ones(118), v[1:-1, 0], v[:-2, 0]]), np.column_stack([np.ones(118), v[1:-1], v[:-2]])
        assert np.isclose(r.f, (rss(small) - rss(full)) / 2 / (rss(full) / 113)) and r.p_value < 0.01
    for r in series.unit_root_test(df, "s", "k", "b", 1).collect():
        v = kept[r.s][:, 1]
        dv = np.diff(v)
        X = np.column_stack([v[1:-1], dv[:-1], np.ones(118)])
        inv = np.linalg.inv(X.T @ X)
        b = inv @ X.T @ dv[1:]
        s2 = ((dv[1:] - X @ b) ** 2).sum() / 115
        assert np.isclose(r.statistic, b[0] / np.sqrt(s2 * inv[0, 0])) and r.stationary
    for r in series.stationarity_test(df, "s", "k", "b", 3).collect():
        e = kept[r.s][:, 1] - kept[r.s][:, 1].mean()
        long_run = (e @ e + 2 * sum((1 - j / 4) * e[j:] @ e[:-j] for j in (1, 2, 3))) / 120
        assert np.isclose(r.statistic, (np.cumsum(e) ** 2).sum() / 120**2 / long_run)
    for r in series.local_projections(df, "s", "k", "a", "b", 1, 2).where("h = 2").collect():
        v = kept[r.s]
        X = np.column_stack([np.ones(117), v[1:-2, 1], v[:-3, 0], v[:-3, 1]])
        b = np.linalg.lstsq(X, v[3:, 0], rcond=None)[0]
        sc = (v[3:, 0] - X @ b) * (X @ np.linalg.inv(X.T @ X)[1])
        assert np.allclose([r.estimate, r.se], [b[1], np.sqrt(sc @ sc + 2 * sum((1 - j / 3) * sc[j:] @ sc[:-j] for j in (1, 2)))])
    got = {r.s: r for r in series.select_lags(df, "s", "k", ["a", "b"], 4).collect()}
    assert all(1 <= r.bic <= r.aic <= 4 for r in got.values())
    r = panels.hac_ols(df, "a", ["b"], "s", "k", 3).where("term = 'b' AND s = 'a'").first()
    v = kept["a"]
    X = np.column_stack([np.ones(120), v[:, 1]])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ v[:, 0]
    s = X * (v[:, 0] - X @ b)[:, None]
    meat = s.T @ s + sum((1 - j / 4) * (s[j:].T @ s[:-j] + s[:-j].T @ s[j:]) for j in (1, 2, 3))
    assert np.allclose([r.estimate, r.se], [b[1], (inv @ meat @ inv)[1, 1] ** 0.5])


def test_synthetic_controls(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(6, 20)).cumsum(1) + 10
    base[5] = 0.3 * base[0] + 0.7 * base[2]
    rows = [(u, p, float(base[u, p] + (4 if u == 5 and p >= 14 else 0)), 14 if u == 5 else None) for u in range(6) for p in range(20)]
    df = spark.createDataFrame(rows, "u int, p int, y double, first int")
    weights = synthetic.synthetic_weights(df, "u", "p", "y", "first", placebo=True)
    w = {r.donor: r.weight for r in weights.where("treated = 5").collect()}
    assert np.isclose(sum(w.values()), 1) and np.allclose([w[0], w[2]], [0.3, 0.7], atol=1e-3)
    effects = synthetic.synthetic_effects(synthetic.synthetic_paths(df, weights, "u", "p", "y", "first"))
    r = synthetic.placebo_p_values(effects).first()
    assert abs(r.effect - 4) < 0.02 and np.isclose(r.p_value, 1 / 6)


def test_forecasts_responses_and_cointegration(spark):
    rng = np.random.default_rng(15)
    v = np.zeros((200, 2))
    for k in range(1, 200):
        v[k] = [0.5 * v[k - 1, 0] + 0.3 * v[k - 1, 1], 0.4 * v[k - 1, 1]] + rng.normal(size=2)
    v += 10
    df = spark.createDataFrame([("s", k, float(a), float(b)) for k, (a, b) in enumerate(v)], "s string, k int, a double, b double")
    X = np.column_stack([np.ones(199), v[:-1]])
    b = np.linalg.lstsq(X, v[1:], rcond=None)[0].T
    one = b @ [1, *v[-1]]
    got = {(r.step, r.variable): r.forecast for r in series.vector_forecast(df, "s", "k", ["a", "b"], 1, 2).collect()}
    assert np.allclose([got[1, "a"], got[1, "b"]], one) and np.allclose([got[2, "a"], got[2, "b"]], b @ [1, *one])
    e = v[1:] - X @ b.T
    p = np.linalg.cholesky(e.T @ e / 196)
    rows = {(r.h, r.response, r.shock): r for r in series.impulse_responses(df, "s", "k", ["a", "b"], 1, 2).collect()}
    want = b[:, 1:] @ b[:, 1:] @ p
    assert np.allclose([[rows[2, i, j].value for j in "ab"] for i in "ab"], want)
    total = sum((np.linalg.matrix_power(b[:, 1:], h) @ p) ** 2 for h in range(3))
    assert np.allclose([[rows[2, i, j].share for j in "ab"] for i in "ab"], total / total.sum(1, keepdims=True))
    walk = rng.normal(size=300).cumsum()
    pair = spark.createDataFrame([(s, k, float(2 * walk[k] + (rng.normal() if s == "tied" else 0.0)), float(walk[k] if s == "tied" else rng.normal() + k % 7)) for s in ("tied", "free") for k in range(300)], "s string, k int, y double, x double")
    assert {r.s: r.cointegrated for r in series.cointegration_test(pair, "s", "k", "y", ["x"], 1).collect()} == {"tied": True, "free": False}


def test_complier_mixture_and_marginal_effects(spark):
    rng = np.random.default_rng(21)
    n = 4000
    kind, z = rng.choice(3, n, p=[0.5, 0.2, 0.3]), rng.integers(0, 2, n)  # compliers, always, never
    d = np.where(kind == 1, 1, np.where(kind == 2, 0, z))
    y = np.choose(kind, [2.0 * d, 6.0 + 0 * d, -4.0 + 0 * d]) + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(y, d, z, strict=True)], "y double, d int, z int")
    r = associations.complier_mixture(df, "y", "d", "z").first()
    assert abs(r.cace - 2) < 0.15 and np.allclose([r.compliers, r.always, r.never], [0.5, 0.2, 0.3], atol=0.03) and r.converged
    x, u = rng.normal(size=n), rng.random(n)
    p = 1 / (1 + np.exp(-x))
    t = (u < p).astype(int)
    out = 1 + t * (3 - 2 * u) + rng.normal(size=n) * 0.1
    df = spark.createDataFrame([(float(a), int(b), float(c), float(q)) for a, b, c, q in zip(out, t, x, p, strict=True)], "y double, t int, x double, p double")
    curve = associations.polynomial_mte(df, "y", "t", ["x"])
    rows = curve.collect()
    assert max(abs(r.mte - (3 - 2 * r.u)) for r in rows if 0.2 < r.u < 0.8) < 0.4
    e = associations.effects_from_mte(curve, df, "t", "p").first()
    assert e.att > e.ate > e.atu
    over = associations.instrument_overlap(df.withColumn("w", F.col("x") * 2), ["x"], ["y", "w"]).first()
    assert over.covariate == "w" and over.collinear
    post = {r.term: r for r in associations.logistic_posterior(df, "t", ["x"], prior_sd=0.01).collect()}
    assert abs(post["x"].estimate) < 0.1 < 0.5
