"""Matching without replacement by proposals between ranges of controls.

Controls are cut by score into blocks of bounded size.  A treated row asks controls
from the nearest outwards; a control holds the smallest id that ever asked it.  When
nobody asks any more, every row holds what it would have got had all rows chosen in
order of id: whoever is refused is refused by a smaller id for good, in whatever
order the questions are put.  So a block settles all that ask within it by itself,
and only rows whose next control lies in another block travel, a block a round.

Controls of one score are asked in order of place; their ids are dealt at the end,
the smallest to the smallest treated id, which is what choosing in order of id gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .moments import number
from .storage import Scratch

#: Controls that a block holds, and rows that may come to ask there in one round.
BLOCK = 250_000
ASKERS = "id long, x double, at int, held boolean, lk int, li int, ls double, rk int, ri int, rs double"
NAMES = [c.split()[0] for c in ASKERS.split(", ")]
#: Index of a row that has not yet been placed among the controls of its first block.
NEW = -2


def _parts(df: DataFrame, size: int, *order: str) -> DataFrame:
    """df with part: its range in the given order, about ``size`` rows each."""
    return df.repartitionByRange(max(1, -(-df.count() // size)), *order).withColumn("part", F.spark_partition_id())


def _ranked(df: DataFrame) -> DataFrame:
    """df (part: ranges in order of s and id) with rank: the place of id among the rows of its score.

    A score may fill many parts: what lies in the parts before is added, a row per part at most."""
    ends = df.groupBy("part").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("part").collect()
    shared = sorted({b.lo for a, b in zip(ends, ends[1:], strict=False) if a.hi == b.lo})
    rows = df.withColumn("rank", F.row_number().over(Window.partitionBy("part", "s").orderBy("id")).cast("long"))
    if not shared:
        return rows
    spark = df.sparkSession
    some = F.broadcast(spark.createDataFrame([(x,) for x in shared], "s double"))
    offsets, before = [], {}
    for r in df.join(some, "s").groupBy("part", "s").agg(F.count(F.lit(1)).alias("n")).orderBy("part", "s").collect():
        offsets.append((r.part, r.s, before.get(r.s, 0)))
        before[r.s] = before.get(r.s, 0) + r.n
    known = F.broadcast(spark.createDataFrame(offsets, "part int, s double, offset long"))
    return rows.join(known, ["part", "s"], "left").withColumn("rank", F.col("rank") + F.coalesce("offset", F.lit(0))).drop("offset")


def _root(links: list[int], k: int) -> int:
    while links[k] != k:
        links[k] = links[links[k]]
        k = links[k]
    return k


class _Blocks:
    """Size and ends of each block of controls, and the steps from one to the next."""

    def __init__(self, sizes: list[int], low: list[float], high: list[float], caliper: float) -> None:
        self.sizes, self.low, self.high, self.caliper = sizes, low, high, caliper

    def below(self, k: int) -> tuple[int, int, float]:
        """Block, index and score of the last control before block k."""
        return (k - 1, self.sizes[k - 1] - 1, self.high[k - 1]) if k else (-1, 0, -np.inf)

    def above(self, k: int) -> tuple[int, int, float]:
        return (k + 1, 0, self.low[k + 1]) if k + 1 < len(self.sizes) else (-1, 0, np.inf)

    def nearer(self, x: float, lk: int, ls: float, rk: int, rs: float) -> int:
        """The block of the nearer control, of two as near the one with the lower score; -1 where none is within the caliper."""
        left, right = (x - ls if lk >= 0 else np.inf), (rs - x if rk >= 0 else np.inf)
        if lk >= 0 and left <= right:
            return lk if left <= self.caliper else -1
        return rk if rk >= 0 and right <= self.caliper else -1

    def first(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Treated rows (id, s) at the first block that reaches their score."""
        high = np.array(self.high)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = np.minimum(np.searchsorted(high, b.s.to_numpy()), len(high) - 1)
                yield pd.DataFrame({"id": b.id, "x": b.s, "at": at, "held": False, "lk": at, "li": NEW, "ls": 0.0, "rk": at, "ri": NEW, "rs": 0.0})

        return run

    def passing(self, full: dict[int, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Rows that ask go past blocks all of whose controls are held by smaller ids (``full``: block, the greatest id there)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for id, x, at, held, lk, li, ls, rk, ri, rs in b.itertuples(index=False):
                    while not held and id > full.get(at, id):
                        here = at
                        if lk == here:
                            lk, li, ls = self.below(here)
                        if rk == here:
                            rk, ri, rs = self.above(here)
                        at = self.nearer(x, lk, ls, rk, rs)
                    out.append((id, x, at, held, lk, li, ls, rk, ri, rs))
                yield pd.DataFrame(out, columns=NAMES)

        return run

    def settle(self) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        """All that hold or ask a control of one block, in order of id, each to the nearest that no smaller id has, or on its way to another block."""

        def run(key: tuple, controls: pd.DataFrame, askers: pd.DataFrame) -> pd.DataFrame:
            k, s = int(key[0]), np.sort(controls.s.to_numpy())
            n = len(s)
            up, down = list(range(n + 1)), list(range(n + 1))  # the next control at or after j that is free; the last one before j
            out = []
            for id, x, _, _, lk, li, ls, rk, ri, rs in askers.sort_values(["id", "x"]).itertuples(index=False):
                if li == NEW:
                    ri = int(np.searchsorted(s, x))
                    li = ri - 1
                if lk == k:
                    li = _root(down, li + 1) - 1
                    if li >= 0:
                        ls = s[li]
                    else:
                        lk, li, ls = self.below(k)
                if rk == k:
                    ri = _root(up, ri)
                    if ri < n:
                        rs = s[ri]
                    else:
                        rk, ri, rs = self.above(k)
                at = self.nearer(x, lk, ls, rk, rs)
                if at == k:
                    j = li if lk == k and (rk < 0 or x - ls <= rs - x) else ri
                    up[j], down[j + 1] = j + 1, j
                out.append((id, x, at, at == k, lk, li, ls, rk, ri, rs))
            return pd.DataFrame(out, columns=NAMES)

        return run


def match_without_replacement(df: DataFrame, key: str, t: str, score: str | Column, caliper: float, block: int = BLOCK) -> DataFrame:
    """Treated rows in order of id each take the nearest control that is still free within the caliper (of two as near, the lower score, then the smaller id): treated_id, control_id, distance.

    Exact however dense the scores: a task holds ``block`` controls, as many rows that
    hold them, and ``block`` that ask.  A round moves rows by one block, or past all
    that smaller ids fill, so rounds grow with the blocks that a caliper spans.  Rows
    without id, arm or finite score take no part; no treated rows or no controls give
    no rows."""
    spark = df.sparkSession
    disk = Scratch(spark)
    own = disk.store(df.select(F.col(key).cast("long").alias("id"), F.col(t).cast("int").alias("t"), number(score).alias("s")).where("id IS NOT NULL AND t IN (0, 1) AND abs(s) < double('infinity')"))
    controls = disk.store(_parts(own.where("t = 0").select("id", "s"), block, "s", "id"))
    ends = controls.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("part").collect()
    if not ends:
        return spark.createDataFrame([], "treated_id long, control_id long, distance double")
    blocks = _Blocks([r.n for r in ends], [r.lo for r in ends], [r.hi for r in ends], caliper)
    places = F.broadcast(spark.createDataFrame([(r.part, k) for k, r in enumerate(ends)], "part int, at int"))
    placed = controls.join(places, "part").select("at", "s")
    state = own.where("t = 1").select("id", "s").mapInPandas(blocks.first(), ASKERS)
    while True:
        counts = {r.at: r for r in state.groupBy("at").agg(F.count_if("held").alias("n"), F.max(F.when(F.col("held"), F.col("id"))).alias("last"), F.count_if(~F.col("held")).alias("asking")).collect()}
        full = {k: r["last"] for k, r in counts.items() if r.n == blocks.sizes[k]}
        asking = {k: r.asking for k, r in counts.items() if r.asking}
        if any(k in full for k in asking):
            state = disk.store(state.mapInPandas(blocks.passing(full), ASKERS).where("at >= 0"))
            asking = {r.at: r["count"] for r in state.where("NOT held").groupBy("at").count().collect()}
        if not asking:
            break
        now = state
        crowded = [k for k, n in asking.items() if n > block]
        if crowded:
            # The smallest ids go first, as many as a task may hold; the others wait a round.
            first = state.where(~F.col("held") & F.col("at").isin(crowded)).withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy("id"))).where(F.col("r") <= block)
            cut = F.broadcast(spark.createDataFrame([(r.at, r.cut) for r in first.groupBy("at").agg(F.max("id").alias("cut")).collect()], "at int, cut long"))
            now = state.join(cut, "at", "left")
            wait = now.where(~F.col("held") & (F.col("id") > F.col("cut"))).select(*NAMES)
            now = now.where(F.col("held") | F.col("cut").isNull() | (F.col("id") <= F.col("cut"))).select(*NAMES)
        live = F.broadcast(spark.createDataFrame([(k,) for k in asking], "at int"))
        moved = placed.join(live, "at").groupBy("at").cogroup(now.join(live, "at").select(*NAMES).groupBy("at")).applyInPandas(blocks.settle(), ASKERS).where("at >= 0")
        after = now.join(live, "at", "left_anti").select(*NAMES).unionByName(moved)
        state = disk.store(after.unionByName(wait) if crowded else after)
    left = (F.col("lk") >= 0) & ((F.col("rk") < 0) | (F.col("x") - F.col("ls") <= F.col("rs") - F.col("x")))
    held = state.select("id", "x", F.when(left, F.col("ls")).otherwise(F.col("rs")).alias("s"))
    treated = _ranked(disk.store(_parts(held, block, "s", "id")))
    both = treated.select("s", "rank", F.col("id").alias("treated_id"), "x").join(_ranked(controls).select("s", "rank", F.col("id").alias("control_id")), ["s", "rank"])
    return both.select("treated_id", "control_id", F.abs(F.col("x") - F.col("s")).alias("distance"))
