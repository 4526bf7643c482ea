"""Dynamic double machine learning: effects of a treatment at lags 0 to L, each freed of those further back.

The nuisance models are ridge regressions on the states, so that all residual moments
of a training set are algebra of one Gram matrix of (1, states, treatments, outcome):
one pass sums it per fold, training sets are sums of folds, and a second pass takes
the influence of each row with its lagged products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .moments import cross_products, frame, inferred, number, square
from .ranks import running


def _folds(rows: DataFrame, how: str, folds: int, unit: str, time: str) -> DataFrame:
    """fold_: by blocks of time of about equal rows (rows of one time together), or by a hash of the unit."""
    if how == "panel":
        return rows.withColumn("fold_", F.pmod(F.xxhash64(unit), F.lit(folds)).cast("int"))
    times = rows.groupBy(number(time).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    total = rows.count()
    placed = running(times, "v", "k").select("v", F.least(F.floor(F.col("before") / max(total // folds, 1)), F.lit(folds - 1)).cast("int").alias("fold_"))
    return rows.join(placed, number(time) == F.col("v")).drop("v")


def _training(grams: dict[int, np.ndarray], how: str, fold: int) -> np.ndarray | None:
    """Blocked and panel: all other folds; rolling and progressive: those before."""
    used = [m for f, m in grams.items() if (f < fold if how in ("rolling", "progressive") else f != fold)]
    return sum(used[1:], used[0]) if used else None


def peeled(m: np.ndarray, states: int, lags: int, ridge: float) -> dict:
    """The backward recursion on a training set's Gram matrix: at each lag h from the last, outcome and treatment less their ridge fits on the states; theta is the residuals' slope, and theta times the treatment is taken off the outcome."""
    x, k = [*range(states + 1)], states + 1
    penalised = m[np.ix_(x, x)] + np.diag([0.0, *[ridge] * states])
    fit = np.linalg.solve(penalised, np.eye(k))
    size, outcome = m.shape[0], np.zeros(m.shape[0])
    outcome[-1] = 1.0
    theta, var, qs, ps, adjusted = np.zeros(lags + 1), np.zeros(lags + 1), [], [], []
    for h in range(lags, -1, -1):
        treatment = np.zeros(size)
        treatment[k + h] = 1.0
        q, p = fit @ m[x] @ outcome, fit @ m[x] @ treatment
        a, b = outcome.copy(), treatment.copy()
        a[:k] -= q
        b[:k] -= p
        var[h] = b @ m @ b / m[0, 0]
        theta[h] = a @ m @ b / m[0, 0] / var[h] if var[h] > 1e-10 else 0.0
        qs.append(a)
        ps.append(b)
        adjusted.append(outcome.copy())
        outcome = outcome - theta[h] * treatment
    return {"theta": theta, "var": var, "a": qs[::-1], "b": ps[::-1]}  # by lag; a and b are the residuals' coefficients on all columns


def dynamic_effects(
    df: DataFrame, y: str, d: str, states: Sequence[str], unit: str, time: str, lags: int, folds: int = 5, how: str = "blocked", ridge: float = 1.0, discount: float = 0.99, bandwidth: int | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """A row per lag (0 to ``lags``) and one of the discounted sum (lag null): estimate, se, p_value, interval, n.

    how: blocked (folds are blocks of time, trained on all others), rolling or
    progressive (trained on the blocks before), panel (folds by unit).  Lags are rows of
    the unit before, in order of time; rows without all of them are left out.  Errors are
    Bartlett's, of influence products up to ``bandwidth`` rows of a unit apart, by default
    4 (n / 100)^(2/9).  A lag's estimate is the folds' mean by their rows."""
    if how not in ("blocked", "rolling", "progressive", "panel"):
        raise ValueError(f"unknown folds {how}")
    names = [f"s{i}" for i in range(len(states))]
    w = Window.partitionBy(unit).orderBy(time)
    rows = frame(df, {"y": y, "d0": d, **dict(zip(names, states, strict=True))}, (), [unit, time])
    lagged = rows.select("*", *[F.lag("d0", h).over(w).alias(f"d{h}") for h in range(1, lags + 1)], F.row_number().over(w).alias("row_")).where(F.col("row_") > lags)
    means = lagged.agg(*[F.avg(c).alias(c) for c in [*names, "y"]]).first()
    n = lagged.count()
    shape = "lag long, estimate double, se double, n long"
    none = inferred(df.sparkSession.createDataFrame([(h, None, None, n) for h in [*range(lags + 1), None]], shape), alpha)
    if not n:
        return none
    own = lagged.withColumns({c: F.col(c) - means[c] for c in [*names, "y"]})
    own = _folds(own, how, folds, unit, time)
    cols = [F.lit(1.0), *map(F.col, names), *[F.col(f"d{h}") for h in range(lags + 1)], F.col("y")]
    grams = {r["fold_"]: square(r["xx"], len(cols)) for r in cross_products(own, cols, ["fold_"]).collect()}  # a row per fold
    fits = {}
    for f in grams:
        m = _training(grams, how, f)
        if m is not None and m[0, 0] > len(cols):
            fits[f] = peeled(m, len(names), lags, ridge)
    used = sum(grams[f][0, 0] for f in fits)
    if not used:
        return none
    theta = sum(fits[f]["theta"] * grams[f][0, 0] for f in fits) / used
    table = lambda get: F.lit([get(fits[f]) if f in fits else None for f in range(folds)])
    at = F.col("fold_")
    scores = []
    for h in range(lags + 1):
        line = lambda part, h=h: sum((F.get(table(lambda fit, j=j: float(fit[part][h][j])), at) * c for j, c in enumerate(cols)), F.lit(0.0))
        t, v = F.get(table(lambda fit, h=h: float(fit["theta"][h])), at), F.get(table(lambda fit, h=h: float(max(fit["var"][h], 1e-10))), at)
        scores.append(F.struct(line("a").alias("a"), line("b").alias("b"), t.alias("t"), v.alias("v")).alias(f"r{h}"))
    parts = own.where(at.isin(*fits)).select(unit, time, *scores)
    psi = [((F.col(f"r{h}.a") - F.col(f"r{h}.t") * F.col(f"r{h}.b")) * F.col(f"r{h}.b") / F.col(f"r{h}.v")).alias(f"p{h}") for h in range(lags + 1)]
    parts = parts.select(unit, time, *psi)
    parts = parts.withColumn(f"p{lags + 1}", sum((float(discount**h) * F.col(f"p{h}") for h in range(lags + 1)), F.lit(0.0)))
    centre = parts.agg(*[F.avg(f"p{h}").alias(f"p{h}") for h in range(lags + 2)]).first()
    parts = parts.withColumns({f"p{h}": F.col(f"p{h}") - centre[h] for h in range(lags + 2)})
    most = bandwidth if bandwidth is not None else int(4 * (used / 100) ** (2 / 9))
    chained = parts.select("*", *[F.lag(f"p{h}", j).over(w).alias(f"p{h}_{j}") for h in range(lags + 2) for j in range(1, most + 1)])
    sums = chained.agg(*[F.sum(F.col(f"p{h}") * (F.col(f"p{h}") if j == 0 else F.col(f"p{h}_{j}"))) for h in range(lags + 2) for j in range(most + 1)]).first()
    gamma = np.nan_to_num(np.array(sums, float)).reshape(lags + 2, most + 1)
    var = gamma[:, 0] + 2 * gamma[:, 1:] @ (1 - np.arange(1, most + 1) / (most + 1))
    se = np.sqrt(np.maximum(var, 0)) / used
    whole = float((theta * discount ** np.arange(lags + 1)).sum())
    out = [(h, float(e), float(s), int(used)) for h, e, s in zip([*range(lags + 1), None], [*theta, whole], se, strict=True)]
    return inferred(df.sparkSession.createDataFrame(out, shape), alpha)
