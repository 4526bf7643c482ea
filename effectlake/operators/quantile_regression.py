"""Regression quantiles by Newton steps on a check loss that is smoothed less and less.

A round is two passes over stored rows: one sums the gradient and the Gram matrix of
the rows within the smoothing's width, one the loss at several step lengths.  When the
width is small only the rows in a band about it are passed over, counted by their values:
the loss of those beyond is linear while their residuals keep their signs, which a pass
over all rows checks in the end.  The rows of least residual name a vertex of the linear
programme, from which a few moves lead to the optimum; multipliers of the rows in it prove
that, and the solution is exact.  Nothing but sums, and a bounded number of rows, leaves
Spark."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .moments import cross_products, frame, inferred, inverted, square
from .ranks import quantiles

#: Step lengths tried in a round.
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
#: Residuals, in standard deviations of the outcome, that count as none.
NONE = 1e-9
#: Moves between vertices after a round, and rows looked at to end one.
PIVOTS, MOST = 30, 1000
#: More rows than this are narrowed to a band.
BAND = 100_000


def _residual(beta: np.ndarray, z: Sequence[Column]) -> Column:
    return F.col("y") - sum((float(b) * c for b, c in zip(beta, z, strict=True)), F.lit(0.0))


def _check(r: Column, tau: float) -> Column:
    return r * (tau - F.when(r < 0, 1.0).otherwise(0.0))


def _vertex(rows: DataFrame, beta: np.ndarray, z: Sequence[Column], tau: float, far: np.ndarray) -> tuple[np.ndarray | None, bool, bool]:
    """The solution through the rows of least residual, moved from vertex to vertex while a row's multiplier lies beyond tau - 1 and tau, times its copies; whether all lie within them, which proves it optimal; and whether the rows name no vertex or no way on.

    ``far`` is the pull of rows that aren't among these.  A move drops that row and goes
    on to the first row at which the loss turns, among the MOST rows that its residuals
    meet first; rows of no residual outside the basis may have a multiplier of 0."""
    k = len(z)
    near = rows.select(F.array(*z).alias("x"), "y", "k", F.abs(_residual(beta, z)).alias("r")).orderBy("r", "x", "y").limit(MOST).collect()
    basis: list[tuple[np.ndarray, float, int]] = []
    for r in near:
        if len(basis) == k:
            break
        if np.linalg.matrix_rank(np.array([*(b[0] for b in basis), r["x"]]), 1e-9) == len(basis) + 1:
            basis.append((np.array(r["x"]), r["y"], r["k"]))
    if len(basis) < k:
        return None, False, True
    for _ in range(PIVOTS):
        x, copies = np.array([b[0] for b in basis]), np.array([b[2] for b in basis])
        found = np.linalg.solve(x, np.array([b[1] for b in basis]))
        e = _residual(found, z)
        side = F.when(F.abs(e) > NONE, tau - F.when(e < 0, 1.0).otherwise(0.0)).otherwise(0.0) * F.col("k")
        pull = np.array(list(rows.agg(*[F.sum(side * c) for c in z]).first())) + far
        multipliers = np.linalg.solve(x.T, -pull)
        beyond = np.maximum(multipliers - tau * copies, (tau - 1) * copies - multipliers)
        i = int(np.argmax(beyond))
        if beyond[i] <= 1e-7 * max(copies.max(), 1):
            return found, True, False
        sign = -1.0 if multipliers[i] > 0 else 1.0
        step = np.linalg.solve(x, sign * np.eye(k)[i])
        speed = sum((float(v) * c for v, c in zip(step, z, strict=True)), F.lit(0.0))
        turns = rows.select(F.array(*z).alias("x"), "y", "k", e.alias("e"), speed.alias("v")).where((F.abs("e") > NONE) & (F.abs("v") > 1e-12)).withColumn("s", F.col("e") / F.col("v")).where("s > 0")
        met = turns.orderBy("s", "x", "y").limit(MOST).collect()
        if not met:
            return found, False, True
        total = np.cumsum([abs(r["v"]) * r["k"] for r in met])
        at = met[min(int(np.searchsorted(total, beyond[i])), len(met) - 1)]
        basis[i] = (np.array(at["x"]), at["y"], at["k"])
        if abs(np.linalg.det(np.array([b[0] for b in basis]))) < 1e-12:
            return found, False, False
    return found, False, False


def _banded(rows: DataFrame, names: Sequence[str], beta: np.ndarray, z: Sequence[Column], tau: float, width: float) -> tuple[DataFrame, np.ndarray, float]:
    """The rows within ``width``, a row for all copies of one; and of the rows beyond it the sums that make up their loss, const - pull @ beta, while their residuals keep their signs."""
    e = _residual(beta, z)
    side = F.when(e > width, tau).when(e < -width, tau - 1).otherwise(0.0)
    got = rows.agg(*[F.coalesce(F.sum(side * c), F.lit(0.0)) for c in [*z, F.col("y")]]).first()
    return rows.where(F.abs(e) <= width).groupBy(*names, "y").agg(F.sum("k").alias("k")).persist(StorageLevel.MEMORY_AND_DISK), np.array(got[:-1]), got[-1]


def _fitted(whole: DataFrame, n: int, names: Sequence[str], start: np.ndarray, z: Sequence[Column], tau: float, rounds: int) -> tuple[np.ndarray, bool, int]:
    beta, width, k = start, 1.0, len(z)
    best, best_loss, at_width = start, np.inf, 0
    rows, far, const, held, centre, band = whole, np.zeros(k), 0.0, None, start, 0.0
    try:
        for done in range(1, rounds + 1):
            e, w = _residual(beta, z), F.col("k")
            slope = tau - F.least(F.greatest((width - e) / (2 * width), F.lit(0.0)), F.lit(1.0))
            inside = w * F.when(F.abs(e) < width, 1 / (2 * width)).otherwise(0.0)
            pairs = [F.sum(inside * z[i] * z[j]) for i in range(k) for j in range(i, k)]
            got = rows.agg(*[F.sum(w * slope * c) for c in z], *pairs, F.count_if(F.abs(e) < width), F.sum(w * _check(e, tau))).first()
            pull, loss = np.array(got[:k]) + far, got[-1] + const - far @ beta
            if loss < best_loss:
                best, best_loss = beta, loss
            step = inverted(square(got[k:-2], k))[0] @ pull
            losses = []
            for s in STEPS:
                r = _residual(beta + s * step, z)
                losses.append(F.sum(w * F.when(F.abs(r) < width, r * (tau - 0.5) + r * r / (4 * width) + width / 4).otherwise(_check(r, tau))))
            tried = [t - far @ (beta + s * step) for t, s in zip(rows.agg(*losses).first(), STEPS, strict=True)]
            beta = beta + STEPS[int(np.argmin(tried))] * step
            at_width += 1
            if np.abs(step).max() > 0.1 * width and at_width < 8:
                continue
            if width < 0.1:
                if held is None:
                    centre, band = beta, 2 * width if n > BAND else np.inf
                    held, far, const = _banded(whole, names, centre, z, tau, band)
                    rows, best_loss = held, np.inf
                if got[-2] <= 10 * MOST or width < 1e-4:
                    found, proven, lost = _vertex(rows, beta, z, tau, far)
                    if found is not None and (proven or lost) and np.isfinite(band):
                        e0, e1 = _residual(centre, z), _residual(found, z)
                        lost = lost or whole.agg(F.count_if(((e0 > band) & (e1 <= NONE)) | ((e0 < -band) & (e1 >= -NONE)))).first()[0] > 0
                    if proven and not lost:
                        return found, True, done
                    if lost and np.isfinite(band):
                        held.unpersist()
                        centre, band = beta if found is None else found, 4 * band
                        held, far, const = _banded(whole, names, centre, z, tau, band)
                        rows, best_loss, beta, at_width = held, np.inf, centre, 0
                        continue
                    if found is not None:
                        at = rows.agg(F.sum(w * _check(_residual(found, z), tau))).first()[0] + const - far @ found
                        if at < best_loss:
                            best, best_loss = found, at
            if width < NONE:
                break
            width, at_width = 0.4 * width, 0
        return best, False, done
    finally:
        if held is not None:
            held.unpersist()


def quantile_regression(df: DataFrame, y: str | Column, xs: Sequence[str | Column], taus: Sequence[float], errors: str = "robust", rounds: int = 80, alpha: float = 0.05) -> DataFrame:
    """Q3: per tau and term (intercept, then xs) the coefficient of the linear tau-quantile of y: tau, term, estimate, se, p_value, interval, n, exact (whether the optimum is proven), rounds.

    Errors are the sandwich with the residuals' density at 0 by an Epanechnikov kernel,
    whose width is Hall and Sheather's; ``iid`` takes that density alone.  Where several
    solutions are optimal, one of them is given.  No rows give nulls."""
    names = [f"x{i}" for i in range(len(xs))]
    terms = ["intercept", *[x if isinstance(x, str) else names[i] for i, x in enumerate(xs)]]
    shape = "tau double, term string, estimate double, se double, n long, exact boolean, rounds long"
    rows = frame(df, {**dict(zip(names, xs, strict=True)), "y": y}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = rows.agg(F.count(F.lit(1)), *[f(c) for c in [*names, "y"] for f in (F.avg, F.stddev_pop)]).first()
        n, mean, sd = seen[0], list(seen[1::2]), [s or 1.0 for s in seen[2::2]]
        if n <= len(xs) + 1:
            none = [(float(t), term, None, None, n, False, 0) for t in taus for term in terms]
            return inferred(df.sparkSession.createDataFrame(none, shape), alpha)
        scaled = rows.select(*[((F.col(c) - m) / s).alias(c) for c, m, s in zip([*names, "y"], mean, sd, strict=True)], F.lit(1).alias("k"))
        z, k = [F.lit(1.0), *map(F.col, names)], len(xs) + 1
        m = square(cross_products(scaled, [*z, F.col("y")]).first()["xx"], k + 1)
        gram, known = inverted(m[:-1, :-1])
        if not known.all():
            raise ValueError("columns that others make up")
        to = np.diag([1.0, *(1 / np.array(sd[:-1]))])
        to[0, 1:] = -np.array(mean[:-1]) / np.array(sd[:-1])
        out = []
        for tau in taus:
            beta, exact, done = _fitted(scaled, n, names, gram @ m[:-1, -1], z, tau, rounds)
            own = scaled.withColumn("e", _residual(beta, z))
            low, high = quantiles(own, "e", [0.25, 0.75]).first()["q"]
            at = stats.normal_quantile(tau)
            density = np.exp(-at * at / 2) / np.sqrt(2 * np.pi)
            share = n ** (-1 / 3) * stats.normal_quantile(0.975) ** (2 / 3) * (1.5 * density**2 / (2 * at**2 + 1)) ** (1 / 3)
            wide = [stats.normal_quantile(min(max(tau + s * share, 1e-6), 1 - 1e-6)) for s in (1, -1)]
            width = min(1.0, (high - low) / 1.34) * (wide[0] - wide[1])  # y has standard deviation 1 here
            se = [None] * k
            if width > 0:
                u = F.col("e") / width
                f0 = own.agg(F.avg(F.greatest(0.75 * (1 - u * u), F.lit(0.0)))).first()[0] / width
                if f0 > 0:
                    spread = F.when(F.col("e") > 0, (tau / f0) ** 2).otherwise(((1 - tau) / f0) ** 2)
                    cov = tau * (1 - tau) / f0**2 * gram if errors == "iid" else gram @ square(cross_products(own, z, weight=spread).first()["xx"], k) @ gram
                    se = (np.sqrt(np.maximum(np.diag(to @ cov @ to.T), 0)) * sd[-1]).tolist()
            found = to @ beta * sd[-1]
            found[0] += mean[-1]
            out += [(float(tau), term, float(b), s, n, exact, done) for term, b, s in zip(terms, found, se, strict=True)]
        return inferred(df.sparkSession.createDataFrame(out, shape), alpha)
    finally:
        rows.unpersist()


def conditional_quantile_effects(df: DataFrame, y: str, t: str, xs: Sequence[str], taus: Sequence[float], errors: str = "robust", alpha: float = 0.05) -> DataFrame:
    """Q3: per tau the coefficient of t in the linear quantile of y on t and xs."""
    return quantile_regression(df, y, [t, *xs], taus, errors, alpha=alpha).where(F.col("term") == t).drop("term")
