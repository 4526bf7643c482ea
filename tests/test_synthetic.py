"""Synthetic controls off balance, augmented and diagnosed, against plain NumPy."""

import itertools

import numpy as np
import pytest

from effectlake.operators import synthetic


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    factors, loads = rng.normal(size=(2, 14)), rng.normal(size=(9, 2))
    values = 50 + loads @ factors + 0.1 * rng.normal(size=(9, 14))
    values[0, 9:] += 3
    values[1, 11:] -= 2
    return values, {0: 9, 1: 11}


@pytest.fixture(scope="module")
def panel(spark, data):
    values, first = data
    return spark.createDataFrame([(u, p, float(values[u, p]), first.get(u)) for u in range(9) for p in range(14)], "u long, p long, y double, g long").cache()


def test_weights_are_the_best_mix(panel, data):
    values, first = data
    got = synthetic.synthetic_weights(panel, "u", "p", "y", "g").collect()
    for t, g in first.items():
        w = {r.donor: r.weight for r in got if r.treated == t}
        v = np.array([w[d] for d in range(2, 9)])
        loss = lambda v: ((values[t, :g] - v @ values[2:, :g]) ** 2).sum()  # noqa: B023, E731
        assert v.min() >= 0 and v.sum() == pytest.approx(1)
        for i, j in itertools.permutations(range(7), 2):
            step = min(v[i], 1e-4)
            move = v.copy()
            move[i] -= step
            move[j] += step
            assert loss(move) >= loss(v) - 1e-9


def test_unbalanced_panels(spark):
    """A donor equal to the treated unit wherever it is seen has all weight if it lacks a period that the unit lacks too, and no part if it lacks one of the unit's."""
    path, other = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0], [2.0] * 6
    rows = [(0, p, v, 4) for p, v in enumerate(path)] + [(1, p, v, None) for p, v in enumerate(path)] + [(2, p, v, None) for p, v in enumerate(other)]
    make = lambda lacks: spark.createDataFrame([r for r in rows if (r[0], r[1]) not in lacks], "u long, p long, y double, g long")
    w = {r.donor: r for r in synthetic.synthetic_weights(make({(1, 1), (0, 1)}), "u", "p", "y", "g").collect()}
    assert w[1].weight == pytest.approx(1, abs=1e-6) and w[1].pre_rmse == pytest.approx(0, abs=1e-5)
    w = {r.donor: r for r in synthetic.synthetic_weights(make({(1, 1)}), "u", "p", "y", "g").collect()}
    assert set(w) == {2} and w[2].weight == pytest.approx(1)
    assert synthetic.synthetic_weights(make({(u, p) for u in (1, 2) for p in range(6)}), "u", "p", "y", "g").count() == 0
    assert synthetic.synthetic_weights(make(set()).limit(0), "u", "p", "y", "g").count() == 0
    after = make({(1, 5)})
    paths = synthetic.synthetic_paths(after, synthetic.synthetic_weights(after, "u", "p", "y", "g"), "u", "p", "y", "g").collect()
    assert {r.period for r in paths} == {0, 1, 2, 3, 4} and all(abs(r.gap) < 1e-4 for r in paths)


def test_too_many_donor_values(panel, monkeypatch):
    monkeypatch.setattr(synthetic, "DONOR_VALUES", 90)
    with pytest.raises(ValueError):
        synthetic.synthetic_weights(panel, "u", "p", "y", "g")


def refit(pre, post, a, b, penalty, w):
    x = np.column_stack([np.ones(len(pre)), pre])
    coef = np.linalg.solve(x.T @ x + penalty * np.diag([0.0, *[1.0] * pre.shape[1]]), x.T @ post)
    return (b - w @ post - (np.append(1, a) @ coef - w @ x @ coef)).mean()


@pytest.mark.parametrize("penalty", [None, 5.0])
def test_augmented_controls_are_refits(panel, data, penalty):
    values, first = data
    got = {r.treated: r for r in synthetic.augmented_synthetic_control(panel, "u", "p", "y", "g", penalty).collect()}
    for t, g in first.items():
        pre, post, a, b = values[2:, :g], values[2:, g:], values[t, :g], values[t, g:]
        used = penalty
        if penalty is None:
            errors = []
            for trial in np.logspace(-2, 4, 20):
                e = []
                for f in range(5):
                    out = np.arange(7) % 5 == f
                    x = np.column_stack([np.ones((~out).sum()), pre[~out]])
                    coef = np.linalg.solve(x.T @ x + trial * np.diag([0.0, *[1.0] * g]), x.T @ post[~out])
                    e += [((post[i] - np.append(1, pre[i]) @ coef) ** 2).mean() for i in np.flatnonzero(out)]
                errors.append(np.mean(e))
            used = np.logspace(-2, 4, 20)[int(np.argmin(errors))]
        assert got[t].penalty == pytest.approx(used)
        assert got[t].estimate == pytest.approx(refit(pre, post, a, b, used, synthetic.mixed(pre, a)), rel=1e-6)
        drawn = []
        for i in range(7):
            keep = np.delete(np.arange(7), i)
            drawn.append(refit(pre[keep], post[keep], a, b, used, synthetic.mixed(pre[keep], a)))
        assert got[t].se == pytest.approx(np.sqrt(6 / 7 * ((drawn - np.mean(drawn)) ** 2).sum()), rel=1e-3) and got[t].n_donors == 7
    assert got[0].ci_lower < got[0].estimate < got[0].ci_upper and abs(got[0].estimate - 3) < 0.3


def test_donor_diagnostics(panel, data):
    values, first = data
    weights = synthetic.synthetic_weights(panel, "u", "p", "y", "g")
    paths = synthetic.synthetic_paths(panel, weights, "u", "p", "y", "g")
    r = {x.treated: x for x in synthetic.donor_diagnostics(weights, paths, 2).collect()}[0]
    w = synthetic.mixed(values[2:, :9], values[0, :9])
    gap = values[0, :9] - w @ values[2:, :9]
    assert r.herfindahl == pytest.approx((w**2).sum(), rel=1e-6) and r.pre_r2 == pytest.approx(1 - (gap**2).mean() / values[0, :9].var(), rel=1e-5)
    assert r.top == ",".join(str(2 + k) for k in np.argsort(-w)[:2]) and r.n_donors == (w > 1e-9).sum()
    out = {x.donor: x for x in synthetic.leave_one_out(panel, "u", "p", "y", "g").where("treated = 0").collect()}
    heaviest = int(np.argmax(w))
    rest = np.delete(values[2:], heaviest, 0)
    v = synthetic.mixed(rest[:, :9], values[0, :9])
    assert out[2 + heaviest].effect_without == pytest.approx((values[0, 9:] - v @ rest[:, 9:]).mean(), rel=1e-6)
    effects = synthetic.synthetic_effects(synthetic.synthetic_paths(panel, synthetic.synthetic_weights(panel, "u", "p", "y", "g", placebo=True), "u", "p", "y", "g"))
    all_ = [x.pre_rmse for x in effects.where("placebo").collect()]
    assert synthetic.well_fitted(effects, 1.0).count() == sum(x <= np.median(all_) for x in all_)
