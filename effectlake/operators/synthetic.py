"""Synthetic controls for many treated units.

Donors, the units never treated, are few against the rows: their paths are a matrix of
donors by periods, which is held to DONOR_VALUES numbers and broadcast.  A treated unit
is one row with its own path, and is solved in a task: nothing of the size of donors by
donors is shuffled.  A donor takes part for a unit if it is seen in all of the periods
before the unit's treatment in which the unit is, so unbalanced panels have a defined
result; a unit without such a donor, or without earlier periods, has no row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import inferred, join_by, number
from .ranks import quantiles, running

#: More donor values (donors x periods) than this are refused: 64 MB of doubles.
DONOR_VALUES = 8_000_000
#: Weights below it count as none.
LEAST_WEIGHT = 1e-9


def simplex_weights(gram: np.ndarray, cross: np.ndarray, rounds: int = 5_000, tolerance: float = 1e-12) -> np.ndarray:
    """Weights on the simplex that minimise w'Gw - 2 c'w, by accelerated projected gradient steps."""
    k = len(cross)
    w = v = np.full(k, 1 / k)
    step, t = 1 / max(2 * float(np.linalg.eigvalsh(gram).max()), 1e-300), 1.0
    for _ in range(rounds):
        x = v - step * 2 * (gram @ v - cross)
        u = np.sort(x)[::-1]
        over = (np.cumsum(u) - 1) / np.arange(1, k + 1)
        new = np.maximum(x - over[np.flatnonzero(u > over)[-1]], 0)
        again = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, t = new + (t - 1) / again * (new - w), again
        if np.abs(new - w).max() < tolerance:
            return new
        w = new
    return w


def mixed(donors: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Weights on the simplex whose mix of the donors' paths (rows) is nearest to the path."""
    level = path.mean()  # weights add up to 1, so a level taken off both sides changes nothing
    x, y = donors - level, path - level
    scale = max(float(np.abs(x).max(initial=0.0)), 1e-300)
    return simplex_weights(x @ x.T / scale**2, x @ y / scale**2)


class Donors:
    """The donors' paths: units, periods (in order) and a matrix of values, NaN where a donor isn't seen."""

    def __init__(self, own: DataFrame):
        rows = own.where("g IS NULL").groupBy("u").agg(F.array_sort(F.collect_list(F.struct("p", "y"))).alias("path")).limit(DONOR_VALUES + 1)
        n, periods = own.where("g IS NULL").agg(F.count_distinct("u"), F.count_distinct("p")).first()
        if n * periods > DONOR_VALUES:
            raise ValueError(f"{n} donors x {periods} periods: more than {DONOR_VALUES} values")
        found = sorted(rows.collect(), key=lambda r: r["u"])  # bounded above
        self.units = [r["u"] for r in found]
        self.periods = sorted({p for r in found for p, _ in r["path"]})
        at = {p: k for k, p in enumerate(self.periods)}
        self.values = np.full((len(self.units), len(self.periods)), np.nan)
        for i, r in enumerate(found):
            for p, y in r["path"]:
                self.values[i, at[p]] = y


def _own(df: DataFrame, unit: str, period: str, y: str, first: str) -> DataFrame:
    return df.select(F.col(unit).alias("u"), F.col(period).alias("p"), number(y).alias("y"), F.col(first).alias("g")).where("y IS NOT NULL AND NOT isnan(y) AND u IS NOT NULL AND p IS NOT NULL")


def _each_unit(own: DataFrame, donors: Donors, placebo: bool, solve: Callable, shape: str) -> DataFrame:
    """``solve`` of each treated unit: its path and the usable donors' over its own periods, which of them are before treatment, and the donors' places.

    With ``placebo`` every donor is also taken as treated, at the earliest treatment,
    with the other donors."""
    spark = own.sparkSession
    kind, when = dict(own.dtypes)["u"], dict(own.dtypes)["p"]
    if not donors.periods:
        return spark.createDataFrame([], f"treated {kind}, {shape}")
    at = spark.createDataFrame([(p, k) for k, p in enumerate(donors.periods)], f"p {when}, at int")
    place = spark.createDataFrame([(u, k) for k, u in enumerate(donors.units)], f"u {kind}, self_ int")
    targets = own.where("g IS NOT NULL")
    if placebo:
        earliest = targets.agg(F.min("g").alias("g"))
        targets = targets.unionByName(own.where("g IS NULL").drop("g").crossJoin(F.broadcast(earliest)).where("g IS NOT NULL").select("u", "p", "y", "g"))
    paths = targets.join(F.broadcast(at), "p").select("u", "at", "y", (F.col("p") < F.col("g")).alias("before"))
    packed = paths.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("at", "y", "before"))).alias("path"))  # a value per period
    packed = packed.join(F.broadcast(place), "u", "left").select(F.col("u").alias("treated"), "self_", F.transform("path", lambda x: x["at"]).alias("at"), F.transform("path", lambda x: x["y"]).alias("y"), F.transform("path", lambda x: x["before"]).alias("before"))
    shared = spark.sparkContext.broadcast(donors.values)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                places, y, before = np.array(r.at, int), np.array(r.y, float), np.array(r.before, bool)
                theirs = shared.value[:, places]
                usable = ~np.isnan(theirs[:, before]).any(1)
                if not pd.isna(r.self_):
                    usable[int(r.self_)] = False
                if before.any() and usable.any():
                    out += [(r.treated, *x) for x in solve(y, theirs[usable], before, np.flatnonzero(usable))]
            yield pd.DataFrame(out, columns=["treated", *names])

    names = [c.split()[0] for c in shape.split(", ")]
    return packed.repartition("treated").mapInPandas(run, f"treated {kind}, {shape}")


def synthetic_weights(df: DataFrame, unit: str, period: str, y: str, first: str, placebo: bool = False) -> DataFrame:
    """Treated, donor, weight, pre_rmse, effective_donors: for each treated unit the weights of the donors whose mix follows it before its treatment.

    df has a row per unit and period and a column ``first``, the unit's first treated
    period (null: never).  With ``placebo`` every donor is also taken as treated, at the
    earliest treatment, with the other donors."""
    own = _own(df, unit, period, y, first)
    donors = Donors(own)

    def solve(path: np.ndarray, theirs: np.ndarray, before: np.ndarray, which: np.ndarray) -> list[tuple]:
        w = mixed(theirs[:, before], path[before])
        rmse = float(np.sqrt(((path[before] - w @ theirs[:, before]) ** 2).mean()))
        return [(int(k), float(v), rmse, float(1 / (w**2).sum())) for k, v in zip(which, w, strict=True)]

    found = _each_unit(own, donors, placebo, solve, "at int, weight double, pre_rmse double, effective_donors double")
    names = df.sparkSession.createDataFrame([(k, u) for k, u in enumerate(donors.units)], f"at int, donor {dict(own.dtypes)['u']}")
    return found.join(F.broadcast(names), "at").select("treated", "donor", "weight", "pre_rmse", "effective_donors")


def synthetic_paths(df: DataFrame, weights: DataFrame, unit: str, period: str, y: str, first: str) -> DataFrame:
    """Treated, period, actual, synthetic, gap, post: each treated unit's path and that of its donors' mix, in periods in which every donor with a weight is seen."""
    own = _own(df, unit, period, y, first).withColumnRenamed("p", "period")
    earliest = own.agg(F.min("g").alias("e_"))
    used = weights.where(F.col("weight") > LEAST_WEIGHT)
    size = used.groupBy("treated").agg(F.count(F.lit(1)).alias("donors_"), F.sum("weight").alias("all_"))
    mix = used.join(own.select(F.col("u").alias("donor"), "period", F.col("y").alias("yd")), "donor").groupBy("treated", "period").agg(F.sum(F.col("weight") * F.col("yd")).alias("sum_"), F.count(F.lit(1)).alias("seen_"))
    mix = mix.join(size, "treated").where("seen_ = donors_").select("treated", "period", (F.col("sum_") / F.col("all_")).alias("synthetic"))
    both = own.select(F.col("u").alias("treated"), "period", F.col("y").alias("actual"), "g").join(mix, ["treated", "period"]).crossJoin(F.broadcast(earliest))
    return both.select("treated", "period", "actual", "synthetic", (F.col("actual") - F.col("synthetic")).alias("gap"), (F.col("period") >= F.coalesce("g", "e_")).alias("post"), F.col("g").isNull().alias("placebo"))


def synthetic_effects(paths: DataFrame) -> DataFrame:
    """Per treated unit the mean gap after treatment, root mean squared gaps before and after, and their ratio."""
    side = lambda post: F.sqrt(F.avg(F.when(F.col("post") == post, F.col("gap") ** 2)))
    out = paths.groupBy("treated", "placebo").agg(F.avg(F.when(F.col("post"), F.col("gap"))).alias("effect"), side(False).alias("pre_rmse"), side(True).alias("post_rmse"))
    return out.withColumn("rmspe_ratio", F.try_divide("post_rmse", "pre_rmse"))


def placebo_p_values(effects: DataFrame) -> DataFrame:
    """Per treated unit (k + 1) / (m + 1), k of the m placebos with a ratio at least as great as its own, by ranks."""
    known = effects.where("rmspe_ratio IS NOT NULL")
    values = known.groupBy("rmspe_ratio").agg(F.count_if("placebo").alias("k"))
    m = known.agg(F.count_if("placebo").alias("m_"))
    below = running(values, "rmspe_ratio", "k").select("rmspe_ratio", "before")
    real = join_by(known.where(~F.col("placebo")), below, ["rmspe_ratio"])
    return join_by(real, m, ()).select("treated", "effect", "rmspe_ratio", ((F.col("m_") - F.col("before") + 1) / (F.col("m_") + 1)).alias("p_value"))


def ridge_penalty(x: np.ndarray, y: np.ndarray, penalties: np.ndarray, folds: int = 5) -> float:
    """The penalty with the least squared error of donors left out, by every ``folds``-th of them; one decomposition a fold serves all penalties."""
    folds, errors = min(folds, len(x)), np.zeros(len(penalties))
    for f in range(folds):
        out = np.arange(len(x)) % folds == f
        mx, my = x[~out].mean(0), y[~out].mean(0)
        u, s, vt = np.linalg.svd(x[~out] - mx, full_matrices=False)
        ahead, back = (x[out] - mx) @ vt.T, u.T @ (y[~out] - my)
        for i, penalty in enumerate(penalties):
            errors[i] += ((y[out] - my - ahead @ (back * (s / (s * s + penalty))[:, None])) ** 2).mean(1).sum()
    return float(penalties[int(np.argmin(errors))])


def augmented_effect(pre: np.ndarray, post: np.ndarray, path_pre: np.ndarray, path_post: np.ndarray, penalty: float | None) -> dict:
    """Z4 for one unit: donors' paths before and after (rows), the unit's own.

    Leaving a donor out moves the ridge fit by one row, which is taken off the inverse,
    and the weights only where the donor has one."""
    n = len(pre)
    if penalty is None:
        penalty = ridge_penalty(pre, post, np.logspace(-2, 4, 20)) if n > 1 else 1.0
    w = mixed(pre, path_pre)
    level = pre.mean()
    a = np.column_stack([np.ones(n), pre - level])
    inverse = np.linalg.inv(a.T @ a + penalty * np.diag([0.0, *[1.0] * pre.shape[1]]))
    coef = inverse @ a.T @ post
    x = np.append(1.0, path_pre - level)

    def effect(weights: np.ndarray, b: np.ndarray, keep: np.ndarray) -> float:
        return float((path_post - weights @ post[keep] - (x - weights @ a[keep]) @ b).mean())

    every = np.arange(n)
    out = {"estimate": effect(w, coef, every), "plain": float((path_post - w @ post).mean()), "penalty": penalty, "n_donors": n, "pre_rmse": float(np.sqrt(((path_pre - w @ pre) ** 2).mean())), "se": None}
    if n > 2:
        drawn = []
        for i in range(n):
            keep = np.delete(every, i)
            h = float(a[i] @ inverse @ a[i])
            if h > 1 - 1e-10:
                continue
            b = coef - np.outer(inverse @ a[i], post[i] - a[i] @ coef) / (1 - h)
            drawn.append(effect(w[keep] / w[keep].sum() if w[i] <= LEAST_WEIGHT else mixed(pre[keep], path_pre), b, keep))
        drawn = np.array(drawn)
        out["se"] = float(np.sqrt((len(drawn) - 1) / len(drawn) * ((drawn - drawn.mean()) ** 2).sum())) if len(drawn) > 1 else None
    return out


def augmented_synthetic_control(df: DataFrame, unit: str, period: str, y: str, first: str, penalty: float | None = None, placebo: bool = False, alpha: float = 0.05) -> DataFrame:
    """Per treated unit the mean gap after treatment to its synthetic control, corrected by a ridge regression of later on earlier values over the donors: treated, estimate, se (jackknife over donors), plain (without the correction), penalty, n_donors, pre_rmse, p_value, interval.

    Without a ``penalty`` it is the one of 20 from 0.01 to 10,000 with the least error over
    five folds of donors.  Donors have to be seen in all of the unit's periods."""
    own = _own(df, unit, period, y, first)

    def solve(path: np.ndarray, theirs: np.ndarray, before: np.ndarray, which: np.ndarray) -> list[tuple]:
        whole = ~np.isnan(theirs).any(1)
        if before.all() or not whole.any():
            return []
        r = augmented_effect(theirs[whole][:, before], theirs[whole][:, ~before], path[before], path[~before], penalty)
        return [(r["estimate"], r["se"], r["plain"], r["penalty"], r["n_donors"], r["pre_rmse"])]

    return inferred(_each_unit(own, Donors(own), placebo, solve, "estimate double, se double, plain double, penalty double, n_donors long, pre_rmse double"), alpha)


def leave_one_out(df: DataFrame, unit: str, period: str, y: str, first: str) -> DataFrame:
    """Per treated unit and donor with a weight, the effect without that donor, beside the effect with all: treated, donor, weight, effect, effect_without, pre_rmse_without."""
    own = _own(df, unit, period, y, first)
    donors = Donors(own)

    def solve(path: np.ndarray, theirs: np.ndarray, before: np.ndarray, which: np.ndarray) -> list[tuple]:
        whole = ~np.isnan(theirs).any(1)
        theirs, which, out = theirs[whole], which[whole], []
        if before.all() or len(which) < 2:
            return []
        w = mixed(theirs[:, before], path[before])
        effect = float((path[~before] - w @ theirs[:, ~before]).mean())
        for i in np.flatnonzero(w > LEAST_WEIGHT):
            rest = np.delete(theirs, i, 0)
            v = mixed(rest[:, before], path[before])
            out.append((int(which[i]), float(w[i]), effect, float((path[~before] - v @ rest[:, ~before]).mean()), float(np.sqrt(((path[before] - v @ rest[:, before]) ** 2).mean()))))
        return out

    found = _each_unit(own, donors, False, solve, "at int, weight double, effect double, effect_without double, pre_rmse_without double")
    names = df.sparkSession.createDataFrame([(k, u) for k, u in enumerate(donors.units)], f"at int, donor {dict(own.dtypes)['u']}")
    return found.join(F.broadcast(names), "at").select("treated", "donor", "weight", "effect", "effect_without", "pre_rmse_without")


def donor_diagnostics(weights: DataFrame, paths: DataFrame, top: int = 5) -> DataFrame:
    """Per treated unit pre_rmse, pre_r2, the weights' Herfindahl index, effective_donors, n_donors with a weight, the greatest weight, and the ``top`` donors by weight, in order."""
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("weight") > LEAST_WEIGHT, F.struct((-F.col("weight")).alias("w"), F.col("donor").cast("string").alias("d"))))), 1, top), lambda x: x["d"])
    per = weights.groupBy("treated").agg(F.sum(F.col("weight") ** 2).alias("herfindahl"), F.count_if(F.col("weight") > LEAST_WEIGHT).alias("n_donors"), F.max("weight").alias("greatest"), F.array_join(best, ",").alias("top"))
    fit = paths.where("NOT post").groupBy("treated").agg(F.sqrt(F.avg(F.col("gap") ** 2)).alias("pre_rmse"), (1 - F.try_divide(F.avg(F.col("gap") ** 2), F.var_pop("actual"))).alias("pre_r2"))
    return per.join(fit, "treated", "left").select("treated", "pre_rmse", "pre_r2", "herfindahl", (1 / F.col("herfindahl")).alias("effective_donors"), "n_donors", "greatest", "top")


def well_fitted(effects: DataFrame, factor: float = 2.0) -> DataFrame:
    """The placebos whose gap before treatment is at most ``factor`` times the placebos' median: donors to keep."""
    own = effects.where("placebo AND pre_rmse IS NOT NULL")
    # Sums in another order move the last digits, which is not to decide about the median's own row.
    return join_by(own, quantiles(own, "pre_rmse", [0.5]), ()).where(F.col("pre_rmse") <= factor * F.col("q")[0] * (1 + 1e-9)).drop("q")
