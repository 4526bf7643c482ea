"""Models for all replicates at once, latent learners and links of lagged series against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlake.operators import latent, links, replicated
from effectlake.operators.resampling import poisson_weight


def newton(x, y, w, rounds=60):
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x.T * (w * p * (1 - p))) @ x, x.T @ (w * (y - p)))
    return b


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(21)
    n = 800
    z, x, u = rng.normal(size=(3, n))
    d = 30 + 2 * z + x + u
    y = (0.4 * (d - 30) - 0.5 * u + 0.3 * x + rng.logistic(size=n) > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), float(d[i]), float(z[i]), float(x[i])) for i in range(n)], "id long, y int, d double, z double, x double").cache()
    return df, y, d, z, x


def weights(spark, seed, n, b):
    return np.array([r.w for r in spark.range(n).select("id", F.lit(b).alias("b")).orderBy("id").select(poisson_weight(seed, "b", "id").alias("w")).collect()])


def test_nonlinear_control_function(spark, binary):
    df, y, d, z, x = binary
    r = replicated.nonlinear_control_function(df, "y", "d", ["z"], "id", ["x"], "logit", 12, seed=3).first()

    def effect(w):
        first = np.column_stack([np.ones(len(y)), z, x])
        v = d - first @ np.linalg.solve((first.T * w) @ first, first.T @ (w * d))
        design = np.column_stack([np.ones(len(y)), d - d.mean(), v, x])
        b = newton(design, y, w)
        p = 1 / (1 + np.exp(-design @ b))
        return b[1] * (w * p * (1 - p)).sum() / w.sum(), b

    whole, b = effect(np.ones(len(y)))
    drawn = [effect(weights(spark, 3, len(y), k))[0] for k in range(1, 13)]
    assert r.estimate == pytest.approx(whole, rel=1e-6) and r.coefficient == pytest.approx(b[1], rel=1e-6) and r.rho == pytest.approx(b[2], rel=1e-5)
    assert r.se == pytest.approx(np.std(drawn, ddof=1), rel=1e-5) and np.allclose([r.ci_lower, r.ci_upper], np.quantile(drawn, [0.025, 0.975]), rtol=1e-5) and r.replicates == 12
    probit = replicated.nonlinear_control_function(df, "y", "d", ["z"], "id", ["x"], "probit", 0).first()
    assert probit.estimate == pytest.approx(whole, rel=0.05) and probit.se is None
    assert replicated.nonlinear_control_function(df.limit(0), "y", "d", ["z"], "id").first().estimate is None


@pytest.fixture(scope="module")
def mediated(spark):
    rng = np.random.default_rng(22)
    n = 1_000
    x = rng.normal(size=n)
    t = rng.integers(0, 2, n)
    m = 0.8 * t + 0.4 * x + rng.normal(size=n)
    q = (0.8 * t - 0.4 + 0.4 * x + rng.logistic(size=n) > 0).astype(float)
    y = 1.0 * t + 0.5 * m + 2 * q + x + rng.normal(size=n)
    return spark.createDataFrame([(i, float(y[i]), int(t[i]), float(m[i]), float(q[i]), float(x[i])) for i in range(n)], "id long, y double, t int, m double, q double, x double").cache(), y, t, m, q, x


def test_mediation_by_simulation(mediated):
    df, y, t, m, q, x = mediated
    one = np.ones(len(y))
    got = {r.effect: r for r in replicated.mediation_effects(df, "y", "t", "m", "id", ["x"], simulations=4, replicates=20).collect()}
    a = np.linalg.lstsq(np.column_stack([one, t, x]), m, rcond=None)[0]
    b = np.linalg.lstsq(np.column_stack([one, t, m, x]), y, rcond=None)[0]
    assert got["direct"].estimate == pytest.approx(b[1], rel=1e-6) and got["indirect"].estimate == pytest.approx(a[1] * b[2], rel=1e-6)
    assert got["mediated"].estimate == pytest.approx(a[1] * b[2] / (b[1] + a[1] * b[2]), rel=1e-6) and got["total"].ci_lower < got["total"].estimate < got["total"].ci_upper
    assert 0 < got["indirect"].se < 0.2 and got["indirect"].p_value == 0
    logit = {r.effect: r for r in replicated.mediation_effects(df, "y", "t", "q", "id", ["x"], mediator="logit", simulations=40, replicates=5).collect()}
    a = newton(np.column_stack([one, t, x]), q, one)
    b = np.linalg.lstsq(np.column_stack([one, t, q, x]), y, rcond=None)[0]
    chance = lambda level: 1 / (1 + np.exp(-np.column_stack([one, level * one, x]) @ a))
    assert logit["indirect"].estimate == pytest.approx(b[2] * (chance(1) - chance(0)).mean(), abs=0.03) and logit["direct"].estimate == pytest.approx(b[1], rel=1e-6)
    both = {r.effect: r.estimate for r in replicated.mediation_effects(df.withColumn("z", (F.col("y") > 1).cast("int")), "z", "t", "m", "id", ["x"], outcome="logit", simulations=40, replicates=0).collect()}
    b = newton(np.column_stack([one, t, m, x]), (y > 1).astype(float), one)
    a, *_ = np.linalg.lstsq(np.column_stack([one, t, x]), m, rcond=None)
    s = np.sqrt(((m - np.column_stack([one, t, x]) @ a) ** 2).sum() / (len(y) - 3))
    draws = np.random.default_rng(0).normal(size=(400, len(y)))
    mean = lambda level, at: (1 / (1 + np.exp(-(b[0] + b[1] * level + b[2] * (a[0] + a[1] * at + a[2] * x + s * draws) + b[3] * x)))).mean()
    assert both["direct"] == pytest.approx(mean(1, 0) - mean(0, 0), abs=0.01) and both["indirect"] == pytest.approx(mean(1, 1) - mean(1, 0), abs=0.01)
    assert all(r.estimate is None for r in replicated.mediation_effects(df.limit(0), "y", "t", "m", "id").collect())


def test_doubly_robust_posterior(mediated):
    df, y, t, _, _, x = mediated
    r = replicated.bayesian_doubly_robust(df, "y", "t", ["x"], draws=60, seed=5).first()
    one = np.ones(len(y))
    design = np.column_stack([one, x])
    mu = [design @ np.linalg.lstsq(design[t == a], y[t == a], rcond=None)[0] for a in (0, 1)]
    ate = lambda e: mu[1] - mu[0] + t * (y - mu[1]) / e - (1 - t) * (y - mu[0]) / (1 - e)
    b = newton(design, t, one)
    p = 1 / (1 + np.exp(-design @ b))
    assert r.estimate == pytest.approx(ate(p).mean(), abs=3 * r.propensity_sd) and r.se == pytest.approx(np.sqrt(max(ate(p).var() / len(y), r.propensity_sd**2 + ate(p).var() / len(y) / 2)), rel=1e-3)
    assert r.ci_lower < r.estimate < r.ci_upper and r.n == len(y)
    own = df.withColumn("g", (F.col("x") > 0).cast("int"))
    s = replicated.bayesian_doubly_robust(own, "y", "t", ["x"], strata=["g"], draws=60, seed=5).first()
    e = np.where(x > 0, (t[x > 0].sum() + 1) / ((x > 0).sum() + 2), (t[x <= 0].sum() + 1) / ((x <= 0).sum() + 2))
    assert s.estimate == pytest.approx(ate(e).mean(), abs=3 * s.propensity_sd) and s == replicated.bayesian_doubly_robust(own, "y", "t", ["x"], strata=["g"], draws=60, seed=5).first()


@pytest.fixture(scope="module")
def strata(spark):
    rng = np.random.default_rng(23)
    n = 900
    g = rng.integers(0, 3, n)
    f = rng.normal(size=n)
    centre = np.array([[0, 0, 0], [6, 0, 3], [0, 7, -3.0]])
    x = centre[g] + np.outer(f, [1, 0.6, -0.5]) + 0.4 * rng.normal(size=(n, 3))
    t = rng.integers(0, 2, n)
    y = t * np.array([1.0, 3.0, -2.0])[g] + x @ [1, 1, 0] + 0.2 * rng.normal(size=n)
    return spark.createDataFrame([(i, float(y[i]), int(t[i]), *map(float, x[i])) for i in range(n)], "id long, y double, t int, a double, b double, c double").cache(), y, t, x, g


def test_factor_scores(strata):
    df, y, t, x, _ = strata
    got = latent.factor_scores(df, ["a", "b", "c"], 2).orderBy("id").collect()
    v = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    v = v * np.sign(v[np.abs(v).argmax(0), [0, 1]])
    assert np.allclose([[r.factor_1, r.factor_2] for r in got], (x - x.mean(0)) @ v, atol=1e-8)
    rng = np.random.default_rng(1)
    f = rng.normal(size=(4_000, 1))
    z = f @ [[2.0, -1.0, 0.5, 1.5]] + rng.normal(size=(4_000, 4)) * [0.5, 1, 1, 0.7]
    made = df.sparkSession.createDataFrame([(i, *map(float, r)) for i, r in enumerate(z)], "id long, a double, b double, c double, d double")
    score = np.array([r.factor_1 for r in latent.factor_scores(made, ["a", "b", "c", "d"], 1, "fa").orderBy("id").collect()])
    assert np.corrcoef(score, f[:, 0])[0, 1] > 0.96
    plain = latent.factor_cate(df, "y", "t", ["a", "b", "c"], 1).agg(F.avg("cate")).first()[0]
    curved = latent.factor_cate(df, "y", "t", ["a", "b", "c"], 2, squares=True).select("cate", "id").orderBy("id").collect()
    f = (x - x.mean(0)) @ v
    design = np.column_stack([np.ones(len(y)), x, f[:, 0] ** 2, f[:, 0] * f[:, 1], f[:, 1] ** 2])
    fit = lambda a: design @ np.linalg.lstsq(design[t == a], y[t == a], rcond=None)[0]
    assert np.allclose([r.cate for r in curved], fit(1) - fit(0), rtol=1e-5, atol=1e-6) and abs(plain - 2 / 3) < 0.5
    assert latent.factor_cate(df, "y", "t", ["a", "b", "c"], 1, "fa", "r").where("cate IS NULL").count() == 0


def test_mixture_strata(strata):
    df, y, t, x, g = strata
    m = latent.Mixture(df, ["a", "b", "c"], 3)
    z = (x - x.mean(0)) / x.std(0)
    # Another round of expectation and maximisation from the same point.
    shares, means, covs = m.shares, m.means, m.covs
    dens = np.stack([s * np.exp(-0.5 * np.einsum("ij,jk,ik->i", z - u, np.linalg.inv(c), z - u)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for s, u, c in zip(shares, means, covs, strict=True)], 1)
    q = dens / dens.sum(1, keepdims=True)
    assert m.converged and np.allclose(q.mean(0), shares, atol=1e-4)
    for j in range(3):
        assert np.allclose((q[:, j] @ z) / q[:, j].sum(), means[j], atol=1e-3)
    rows = latent.mixture_cate(df, "y", "t", ["a", "b", "c"], 3).orderBy("id").collect()
    assert all(len(set(g[[r.stratum == s for r in rows]])) == 1 for s in range(3))
    for s in range(3):
        at = np.array([r.stratum == s for r in rows])
        fit = lambda arm: np.linalg.lstsq(np.column_stack([np.ones((at & (t == arm)).sum()), x[at & (t == arm)]]), y[at & (t == arm)], rcond=None)[0]  # noqa: B023, E731
        assert np.allclose([r.cate for r in rows if r.stratum == s], np.column_stack([np.ones(at.sum()), x[at]]) @ (fit(1) - fit(0)), rtol=1e-5, atol=1e-6)
    whole = latent.mixture_ate(latent.mixture_cate(df, "y", "t", ["a", "b", "c"], 3)).first()
    assert whole.estimate == pytest.approx(np.mean([r.cate for r in rows])) and whole.n_strata == 3


@pytest.fixture(scope="module")
def system(spark):
    rng = np.random.default_rng(24)
    n = 500
    e = rng.normal(size=(n, 3))
    v = np.zeros((n, 3))
    for i in range(2, n):
        v[i, 0] = 0.5 * v[i - 1, 0] + e[i, 0]
        v[i, 1] = 0.3 * v[i - 1, 1] + 0.6 * v[i - 1, 0] + e[i, 1] + 0.5 * e[i, 0]
        v[i, 2] = 0.7 * v[i - 2, 1] + e[i, 2]
    z = e[:, 0] + rng.normal(size=n)
    return spark.createDataFrame([("s", i, *map(float, v[i] * [1, 1e6, 1] + 5), float(z[i])) for i in range(n)], "series string, t long, x double, y double, w double, z double").cache(), v * [1, 1e6, 1] + 5, z


def test_lagged_links(system):
    df, v, _ = system
    rows = links.lagged_links(df, "series", "t", ["x", "y", "w"], 2, 0.01).collect()
    assert {("x", 1, "y"), ("y", 2, "w"), ("x", 1, "x"), ("y", 1, "y")} <= {(r.source, r.lag, r.target) for r in rows if r.link} and len(rows) == 18
    assert sum(r.link for r in rows) <= 6
    # One test by regression: y at lag 2 and w, given w's other parents and y's own.
    links_of = lambda c: {(r.source, r.lag) for r in rows if r.target == c}
    assert len(links_of("w")) == 6
    r = next(r for r in rows if (r.source, r.lag, r.target) == ("y", 2, "w"))
    assert 0.4 < r.partial < 0.8 and r.n == 496


def var_fit(v, lags):
    t = np.arange(lags, len(v))
    x = np.column_stack([np.ones(len(t)), *[v[t - h] for h in range(1, lags + 1)]])
    b = np.linalg.lstsq(x, v[t], rcond=None)[0]
    return b, v[t] - x @ b


def test_proxy_impacts(system):
    df, v, z = system
    got = {r.variable: r for r in links.proxy_impacts(df, "series", "t", ["x", "y", "w"], 2, "z", "x").collect()}
    _, u = var_fit((v - v.mean(0)) / [1, 1e6, 1], 2)
    zz = z[2:] - z[2:].mean()
    c = zz @ (u - u.mean(0))
    r2 = c[0] ** 2 / (zz @ zz) / ((u[:, 0] - u[:, 0].mean()) ** 2).sum()
    assert np.allclose([got[k].impact / s for k, s in (("x", 1), ("y", 1e6), ("w", 1))], c / c[0], rtol=1e-6, atol=1e-9)
    assert got["x"].first_stage_r2 == pytest.approx(r2, rel=1e-6) and got["x"].first_stage_f == pytest.approx(r2 / (1 - r2) * 496, rel=1e-6) and not got["x"].weak


def test_historical_decomposition(system):
    df, v, _ = system
    rows = links.historical_decomposition(df.where("t < 60"), "series", "t", ["x", "w"], 1).collect()
    own = v[:60][:, [0, 2]]
    b, u = var_fit(own - own.mean(0), 1)
    root = np.linalg.cholesky(u.T @ u / (len(u) - 3))
    e = np.linalg.solve(root, u.T).T
    a = b[1:].T
    for k, name in enumerate(("x", "w")):
        state, made = np.zeros(2), []
        for s in range(59):
            state = a @ state + root[:, k] * e[s, k]
            made.append(state.copy())
        got = {(r.t, r.variable): r.value for r in rows if r.shock == name}
        assert np.allclose([[got[s + 1, "x"], got[s + 1, "w"]] for s in range(59)], made, atol=1e-8)
    total = {}
    for r in rows:
        total[r.t, r.variable] = total.get((r.t, r.variable), 0) + r.value
    assert np.allclose([total[s, "x"] for s in range(1, 60)], own[1:, 0])


def test_replicates_by_distinct_rows(spark, monkeypatch):
    """Few distinct rows are counted per replicate before models are fitted, with the same results as from all rows."""
    n, rng = 3_000, np.random.default_rng(8)
    z, x, d, t, y = rng.integers(0, 2, n), rng.integers(0, 4, n), rng.integers(0, 5, n), rng.integers(0, 2, n), rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(int, r[:-1]), float(r[-1])) for i, r in enumerate(zip(z, x, d, t, (z + x + d + t + rng.normal(0, 3, n) > 5), y, strict=True))], "id long, z int, x int, d int, t int, h int, y double")
    fitted, out, seen = replicated.Replicates.fitted, [], []
    monkeypatch.setattr(replicated.Replicates, "fitted", lambda self, *a, **k: seen[-1].append(self.rows.count()) or fitted(self, *a, **k))
    for few in (1, 10**9):
        monkeypatch.setattr(replicated, "FEW", few)
        seen.append([])
        out.append([tuple(replicated.nonlinear_control_function(df, "h", "d", ["z"], "id", ["x"], replicates=4).first())] + [tuple(r)[1:] for r in replicated.mediation_effects(df, "y", "t", "h", "id", ["x"], mediator="logit", simulations=2, replicates=4).collect()])
    assert all(np.allclose(a, b, rtol=1e-7) for a, b in zip(*out, strict=True))
    assert max(seen[0][:3]) <= 5 * 2 * 4 * 5 * 2 and min(seen[1]) > n
