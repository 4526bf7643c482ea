"""Nearest matches on a score, effects on matched rows, and balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .experiments import smd_table
from .moments import inferred, join_by, number
from .one_to_one import match_without_replacement
from .propensity import with_propensity
from .storage import Scratch


def _closest(own: DataFrame, controls: DataFrame, caliper: float, k: int) -> DataFrame:
    """For each row of own (id, s) the k nearest of controls (s, cs: ids at that score) on either side within the caliper: treated_id, control_id, distance, match.

    Scores are cut into ranges of as many rows, whatever the caliper.  Each range also
    gets the k controls next to it on either side, from the ends of the other ranges:
    2 k rows a range, gathered on the driver."""
    spark = own.sparkSession
    every = own.select("id", "s", F.lit(None).cast("array<bigint>").alias("cs")).unionByName(controls.select(F.lit(None).cast("long").alias("id"), "s", "cs"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = Scratch(spark).store(every.repartitionByRange(ranges, "s").withColumn("b", F.spark_partition_id()))
    own, near = placed.where("cs IS NULL").select("id", "s", "b"), placed.where("cs IS NOT NULL").select("s", "cs", "b")
    end = lambda order: near.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(order))).where(F.col("r") <= k).drop("r")
    first, last = ([tuple(r) for r in end(order).orderBy("s").collect()] for order in (F.col("s").asc(), F.col("s").desc()))
    beside = [(s, cs, b) for b in range(ranges) for s, cs, _ in [*[r for r in last if r[2] < b][-k:], *[r for r in first if r[2] > b][:k]]]
    near = near.unionByName(spark.createDataFrame(beside, "s double, cs array<bigint>, b int"))
    both = own.withColumn("cs", F.lit(None).cast("array<bigint>")).unionByName(near.withColumn("id", F.lit(None).cast("long")))
    seen = F.when(F.col("cs").isNotNull(), F.struct("s", "cs"))
    up = Window.partitionBy("b").orderBy("s", F.col("cs").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("b").orderBy(F.col("s").desc(), F.col("cs").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda w: F.last(seen, ignorenulls=True).over(w)
    if k == 1:
        found = both.select("id", "s", last(up).alias("lo"), last(down).alias("hi")).where("id IS NOT NULL")
        sides = F.filter(F.array("lo", "hi"), lambda x: x.isNotNull())
    else:
        # The k nearest distinct scores on a side: each score carries those before it, k at most.
        scores = near.select("b", "s", "cs")
        own_up, own_down = Window.partitionBy("b").orderBy("s").rowsBetween(-(k - 1), 0), Window.partitionBy("b").orderBy(F.col("s").desc()).rowsBetween(-(k - 1), 0)
        chained = scores.select("b", "s", F.collect_list(F.struct("s", "cs")).over(own_up).alias("u"), F.collect_list(F.struct("s", "cs")).over(own_down).alias("d"))
        both = own.select("id", "s", "b", F.lit(None).cast("array<struct<s:double,cs:array<bigint>>>").alias("u"), F.lit(None).cast("array<struct<s:double,cs:array<bigint>>>").alias("d"))
        both = both.unionByName(chained.select(F.lit(None).cast("long").alias("id"), "s", "b", "u", "d"))
        up = Window.partitionBy("b").orderBy("s", F.col("u").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy("b").orderBy(F.col("s").desc(), F.col("d").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = both.select("id", "s", F.last("u", ignorenulls=True).over(up).alias("lo"), F.last("d", ignorenulls=True).over(down).alias("hi")).where("id IS NOT NULL")
        sides = F.array_distinct(F.concat(F.coalesce("lo", F.array().cast("array<struct<s:double,cs:array<bigint>>>")), F.coalesce("hi", F.array().cast("array<struct<s:double,cs:array<bigint>>>"))))
    each = F.flatten(F.transform(sides, lambda x: F.transform(x["cs"], lambda c: F.struct(F.abs(F.col("s") - x["s"]).alias("distance"), x["s"].alias("at"), c.alias("c")))))
    ranked = F.slice(F.array_sort(F.array_distinct(F.filter(each, lambda x: x["distance"] <= caliper))), 1, k)
    out = found.select(F.col("id").alias("treated_id"), F.posexplode(ranked).alias("match", "x"))
    return out.select("treated_id", F.col("x.c").alias("control_id"), F.col("x.distance").alias("distance"), (F.col("match") + 1).cast("long").alias("match"))


def nearest_match(df: DataFrame, key: str, t: str, score: str | Column, caliper: float, k: int = 1) -> DataFrame:
    """For each treated row the k controls with the nearest scores within the caliper (with replacement; of two as near, the lower score, then the smaller id): treated_id, control_id, distance, match.

    Controls of one score are first reduced to their k smallest ids; within a range
    of scores an ordered window finds the ones on either side, so nothing is ever
    paired with everything.  Rows without a score take no part."""
    own = df.select(F.col(key).cast("long").alias("id"), F.col(t).cast("int").alias("t"), number(score).alias("s")).where(F.col("s").isNotNull() & ~F.isnan("s"))
    # Treated rows of one score have the same matches: they are looked up once.
    wanted = own.where("t = 1").groupBy("s").agg(F.min("id").alias("id"))
    if k == 1:
        controls = own.where("t = 0").groupBy("s").agg(F.array(F.min("id")).alias("cs"))
    else:
        first = own.where("t = 0").withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("id"))).where(F.col("r") <= k)
        controls = first.groupBy("s").agg(F.array_sort(F.collect_list("id")).alias("cs"))  # k ids at most
    found = _closest(wanted, controls, caliper, k).withColumnRenamed("treated_id", "first_")
    rows = own.where("t = 1").select(F.col("id").alias("treated_id"), "s").join(wanted.withColumnsRenamed({"id": "first_", "s": "s_"}), F.col("s") == F.col("s_"))
    return rows.select("treated_id", "first_").join(found, "first_").drop("first_")


def matched_effect(df: DataFrame, pairs: DataFrame, key: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Effect on the matched treated, each less the mean of its matches, with the variance of the differences and the normal interval.  pairs: treated_id, control_id."""
    treated = df.select(F.col(key).alias("treated_id"), number(y).alias("a"))
    control = df.select(F.col(key).alias("control_id"), number(y).alias("b"))
    own = pairs.join(control, "control_id").groupBy("treated_id").agg(F.avg("b").alias("b")).join(treated, "treated_id").select((F.col("a") - F.col("b")).alias("g"))
    return inferred(own.agg(F.avg("g").alias("estimate"), F.sqrt(F.var_samp("g") / F.count("g")).alias("se"), F.count("g").alias("n_matched")), alpha)


def matching_variance(df: DataFrame, pairs: DataFrame, key: str, t: str, y: str, k: int = 1, alpha: float = 0.05) -> DataFrame:
    """The matched effect with the imputation variance: the mean squared gap of the treated to their matches, plus k / n_controls times the squared gaps of the used controls to those they serve, over the number matched."""
    treated = df.select(F.col(key).alias("treated_id"), number(y).alias("a"))
    control = df.select(F.col(key).alias("control_id"), number(y).alias("b"))
    both = pairs.select("treated_id", "control_id").join(control, "control_id").join(treated, "treated_id")
    one = both.groupBy("treated_id").agg(F.max("a").alias("a"), F.avg("b").alias("b")).agg(F.avg(F.col("a") - F.col("b")).alias("estimate"), F.avg((F.col("a") - F.col("b")) ** 2).alias("v1"), F.count(F.lit(1)).alias("n_matched"))
    two = both.groupBy("control_id").agg(F.max("b").alias("b"), F.avg("a").alias("a")).agg(F.sum((F.col("b") - F.col("a")) ** 2).alias("v0"), F.count(F.lit(1)).alias("n_controls_used"))
    n0 = df.where(F.col(t) == 0).agg(F.count(F.lit(1)).alias("n0"))
    out = join_by(join_by(one, two, ()), n0, ())
    se = F.sqrt((F.col("v1") + k * F.col("v0") / F.col("n0")) / F.col("n_matched"))
    return inferred(out.select("estimate", se.alias("se"), "n_matched", "n_controls_used"), alpha)


def common_support(df: DataFrame, t: str, p: str | Column, by: Sequence[str] = (), margin: float = 0.0) -> DataFrame:
    """V6, V7: the scores that both arms reach: from the greater of the arms' least (or ``margin`` quantile) to the lesser of their greatest, and how many rows lie outside."""
    rows = df.select(*by, F.col(t).cast("int").alias("t"), number(p).alias("p")).where("p IS NOT NULL AND t IN (0, 1)")
    if margin:
        from .ranks import quantiles

        ends = quantiles(rows, "p", [margin, 1 - margin], [*by, "t"])
        arm = lambda i, a: F.max(F.when(F.col("t") == a, F.col("q")[i]))
        m = (ends.groupBy(*by) if by else ends.groupBy()).agg(F.greatest(arm(0, 0), arm(0, 1)).alias("low"), F.least(arm(1, 0), arm(1, 1)).alias("high"))
    else:
        end = lambda f, a: f(F.when(F.col("t") == a, F.col("p")))
        m = (rows.groupBy(*by) if by else rows.groupBy()).agg(F.greatest(end(F.min, 0), end(F.min, 1)).alias("low"), F.least(end(F.max, 0), end(F.max, 1)).alias("high"))
    both = join_by(rows, m, by)
    outside = F.count_if(~F.col("p").between(F.col("low"), F.col("high")))
    return (both.groupBy(*by) if by else both.groupBy()).agg(F.max("low").alias("low"), F.max("high").alias("high"), outside.alias("n_outside"), F.count(F.lit(1)).alias("n"), (F.max("low") <= F.max("high")).alias("overlap"))


def matched_balance(df: DataFrame, pairs: DataFrame, key: str, t: str, xs: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """Per covariate the standardised difference and variance ratio before matching and over the matched pairs (first matches), whether the latter is within the threshold, and by how much matching improved it."""
    before = smd_table(df, t, xs).select("covariate", F.col("smd").alias("smd_before"), F.col("variance_ratio").alias("ratio_before"))
    first = pairs.where("match = 1") if "match" in pairs.columns else pairs
    sides = first.select(F.col("treated_id").alias("id_"), F.lit(1).alias("t_")).unionByName(first.select(F.col("control_id").alias("id_"), F.lit(0).alias("t_")))
    after = smd_table(df.join(sides, F.col(key) == F.col("id_")).select(*xs, "t_"), "t_", xs).select("covariate", F.col("smd").alias("smd_after"), F.col("variance_ratio").alias("ratio_after"))
    return before.join(after, "covariate").select("*", (F.abs("smd_after") < threshold).alias("balanced"), (F.abs("smd_before") - F.abs("smd_after")).alias("improvement"))


def balance_summary(balance: DataFrame) -> DataFrame:
    """Over the covariates of matched_balance: greatest and mean size of the difference before and after, and how many are balanced."""
    return balance.agg(
        F.max(F.abs("smd_before")).alias("max_before"), F.avg(F.abs("smd_before")).alias("mean_before"), F.max(F.abs("smd_after")).alias("max_after"), F.avg(F.abs("smd_after")).alias("mean_after"),
        F.count_if("balanced").alias("n_balanced"), F.count(F.lit(1)).alias("n_covariates"),
    )


def psm_ate(df: DataFrame, y: str, t: str, xs: Sequence[str], key: str, caliper: float, k: int = 1, replacement: bool = True, alpha: float = 0.05) -> DataFrame:
    """Propensity model, common support, matches, effect on the treated with the imputation variance (the paired one for single matches without replacement), and balance: one row."""
    scored = with_propensity(df, t, xs)
    pairs = nearest_match(scored, key, t, "p", caliper, k) if replacement else match_without_replacement(scored, key, t, "p", caliper)
    effect = matching_variance(scored, pairs, key, t, y, k, alpha) if replacement else matched_effect(scored, pairs, key, y, alpha)
    support = common_support(scored, t, "p").select("low", "high", F.col("n_outside").alias("n_off_support"))
    return join_by(join_by(effect, support, ()), balance_summary(matched_balance(scored, pairs, key, t, xs)), ())
