"""Matches against one pass over all rows, with blocks so small that rows travel between them."""

import numpy as np
import pytest

from effectlake.operators import matching


def greedy(rows, caliper):
    used, out = set(), {}
    for i, t, s in sorted(r for r in rows if r[0] is not None and r[2] is not None):
        near = [(abs(s - b), b, j) for j, u, b in rows if t == 1 and u == 0 and b is not None and j not in used and abs(s - b) <= caliper]
        if near:
            d, _, out[i] = min(near)
            used.add(out[i])
    return out


def once(spark, rows, caliper, block):
    found = matching.match_without_replacement(spark.createDataFrame(rows, "id long, t int, s double"), "id", "t", "s", caliper, block).collect()
    scores = {r[0]: r[2] for r in rows}
    assert all(r.distance == abs(scores[r.treated_id] - scores[r.control_id]) for r in found)
    assert len({r.treated_id for r in found}) == len({r.control_id for r in found}) == len(found)
    return {r.treated_id: r.control_id for r in found}


@pytest.mark.parametrize(
    ("share", "caliper", "digits"),
    # Few treated rows, dense scores and a wide caliper; more treated than controls; every score tied.
    [(0.3, 0.4, 12), (0.7, 0.2, 12), (0.7, 5.0, 12), (0.5, 0.3, 1), (0.8, 1.0, 1)],
)
def test_without_replacement_in_blocks(spark, share, caliper, digits):
    rng = np.random.default_rng(int(100 * share + 10 * caliper + digits))
    rows = [(int(i), int(rng.random() < share), float(np.round(rng.uniform(0, 1.5), digits))) for i in rng.permutation(260)]
    want = greedy(rows, caliper)
    assert once(spark, rows, caliper, 15) == want
    assert once(spark, rows, caliper, 1_000) == want


def test_one_score_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.random() < 0.6), 0.5 if rng.random() < 0.5 else float(rng.uniform())) for i in rng.permutation(200)]
    assert once(spark, rows, 0.2, 10) == greedy(rows, 0.2)


def test_without_replacement_odd_rows(spark):
    rows = [(1, 1, 0.0), (2, 0, None), (3, 0, float("nan")), (4, 0, float("inf")), (5, None, 0.0), (None, 0, 0.0), (6, 0, -0.5), (7, 0, 0.5), (8, 1, None)]
    df = spark.createDataFrame(rows, "id long, t int, s double")
    pairs = lambda d: [(r.treated_id, r.control_id) for r in matching.match_without_replacement(d, "id", "t", "s", 1.0).collect()]
    assert pairs(df) == [(1, 6)]
    assert pairs(df.where("t = 1")) == pairs(df.where("t = 0")) == pairs(df.limit(0)) == []


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_across_ranges(spark, k):
    # A caliper as wide as all scores, controls far from some treated rows, ranges without controls.
    rng = np.random.default_rng(k)
    rows = [(i, 1, float(rng.uniform(0, 100))) for i in range(150)] + [(200 + i, 0, float(np.round(rng.uniform(0, 4) + 90 * (i % 2), 1))) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t int, s double")
    got = {(r.treated_id, r.match): r.control_id for r in matching.nearest_match(df, "id", "t", "s", 200.0, k).collect()}
    want = {}
    for i, t, s in rows:
        if t:
            want |= {(i, m + 1): c[2] for m, c in enumerate(sorted((abs(s - b), b, j) for j, u, b in rows if not u)[:k])}
    assert got == want
    assert matching.nearest_match(df.where("t = 1"), "id", "t", "s", 1.0, k).count() == matching.nearest_match(df.limit(0), "id", "t", "s", 1.0, k).count() == 0
