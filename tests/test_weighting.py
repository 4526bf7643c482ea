import hashlib

import numpy as np
import pytest

from effectlake.functions import stats
from effectlake.operators import instruments, propensity


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 1500
    x, z1, z2, u = rng.normal(size=(4, n))
    d = 0.6 * z1 + 0.4 * z2 + 0.3 * x + u + rng.normal(size=n)
    y = 1 + 2 * d + x + u * (1 + 0.2 * np.abs(z1)) + rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-0.4 - 0.8 * x))).astype(int)
    rows = [(i, float(y[i]), float(d[i]), float(z1[i]), float(z2[i]), float(x[i]), int(t[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, d double, z1 double, z2 double, x double, t int").cache(), y, d, np.column_stack([z1, z2]), x, t


def test_gmm_against_numpy(data):
    df, y, d, z, x, _ = data
    n = len(y)
    zx, reg = np.column_stack([np.ones(n), x, z]), np.column_stack([np.ones(n), x, d])
    w = np.linalg.inv(zx.T @ zx / n)
    for _ in range(2):
        g = reg.T @ zx / n
        beta = np.linalg.solve(g @ w @ g.T, g @ w @ zx.T @ y / n)
        e, used = y - reg @ beta, w
        w = np.linalg.inv((zx.T * e**2) @ zx / n)
    bread = np.linalg.inv(g @ used @ g.T)
    se = np.sqrt((bread @ g @ used @ np.linalg.inv(w) @ used @ g.T @ bread / n)[-1, -1])
    m = (zx.T @ e / n)[2:]
    r = instruments.gmm(df, "y", "d", ["z1", "z2"], ["x"]).first()
    assert np.allclose([r.estimate, r.se, r.j], [beta[-1], se, n * m @ used[2:, 2:] @ m]) and r.j_df == 1


def test_k_class_against_numpy(data):
    df, y, d, z, x, _ = data
    n = len(y)
    zx, one = np.column_stack([np.ones(n), x, z]), np.column_stack([np.ones(n), x])
    off = lambda a, b: b - a @ np.linalg.lstsq(a, b, rcond=None)[0]
    w, reg = np.column_stack([d, y]), np.column_stack([one, d])
    kappa = np.linalg.eigvals(np.linalg.solve(w.T @ off(zx, w), w.T @ off(one, w))).real.min()
    beta = np.linalg.solve(reg.T @ reg - kappa * reg.T @ off(zx, reg), reg.T @ y - kappa * reg.T @ off(zx, y))
    r = instruments.k_class(df, "y", "d", ["z1", "z2"], ["x"]).first()
    assert np.allclose([r.estimate, r.kappa], [beta[-1], kappa])
    f = instruments.k_class(df, "y", "d", ["z1", "z2"], ["x"], fuller=1.0).first()
    assert np.isclose(f.kappa, kappa - 1 / (n - 4))


def test_control_function_is_two_stage_and_set_holds_the_effect(data):
    df = data[0]
    two = instruments.tsls(df, "y", "d", ["z1", "z2"], ["x"]).first()
    assert np.isclose(instruments.control_function(df, "y", "d", ["z1", "z2"], ["x"]).first().estimate, two.estimate)
    r = instruments.anderson_rubin(df, "y", "d", ["z1", "z2"], ["x"]).first()
    assert r.lower < 2 < r.upper and r.p_value < 0.01
    s = instruments.instrument_strength(df, "d", ["z1", "z2"], ["x"]).first()
    assert np.isclose(s.f, two.first_stage_f) and s.strength == "strong"


def test_logit_solves_its_score(data):
    df, _, _, _, x, t = data
    b = propensity.logit(df, "t", ["x"])
    p = 1 / (1 + np.exp(-b[0] - b[1] * x))
    assert abs((t - p).sum()) < 1e-6 and abs(((t - p) * x).sum()) < 1e-6
    r = propensity.propensity_fit(propensity.with_propensity(df, "t", ["x"]), "t").first()
    assert np.isclose(r.auc, (p[t == 1][:, None] > p[t == 0][None, :]).mean())
    ll = np.log(np.where(t == 1, p, 1 - p)).sum()
    q = t.mean()
    assert np.isclose(r.pseudo_r2, 1 - ll / (len(t) * (q * np.log(q) + (1 - q) * np.log(1 - q))))


def test_tmle_against_numpy(data):
    df, y, _, _, x, t = data
    b = propensity.logit(df, "t", ["x"])
    p = 1 / (1 + np.exp(-b[0] - b[1] * x))
    fit = [np.polyfit(x[t == a], y[t == a], 1) for a in (0, 1)]
    m0, m1 = np.polyval(fit[0], x), np.polyval(fit[1], x)
    h = np.where(t == 1, 1 / p, -1 / (1 - p))
    e = (h * (y - np.where(t == 1, m1, m0))).sum() / (h * h).sum()
    m1, m0 = m1 + e / p, m0 - e / (1 - p)
    psi = (m1 - m0).mean()
    se = np.sqrt(((h * (y - np.where(t == 1, m1, m0)) + m1 - m0 - psi) ** 2).mean() / len(y))
    scored = propensity.with_outcome_models(propensity.with_propensity(df, "t", ["x"]), "y", "t", ["x"])
    r = propensity.tmle(scored, "y", "t").first()
    assert np.allclose([r.estimate, r.se, r.epsilon], [psi, se, e])


def test_permutation_against_brute_force(data):
    df, y, _, _, _, t = data
    n1, n = t.sum(), len(t)
    seen, more = y[t == 1].mean() - y[t == 0].mean(), 0
    for b in range(1, 21):
        order = sorted(range(n), key=lambda i: hashlib.md5(f"0:{b}:{i}".encode()).hexdigest())
        more += abs(y[order[:n1]].mean() - y[order[n1:]].mean()) >= abs(seen)
    r = propensity.permutation_test(df, "y", "t", "id", 20).first()
    assert (r.n_extreme, r.replicates) == (more, 20) and np.isclose(r.estimate, seen)


def test_chi_squared():
    assert np.isclose(stats.chi2_tail(3.841458820694124, 1), 0.05) and np.isclose(stats.chi2_tail(7.814727903251179, 3), 0.05)
    assert np.isclose(stats.chi2_quantile(0.95, 2), 5.991464547107979)
