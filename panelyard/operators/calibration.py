"""Settings judged on truth-known runs: grids, two-level summaries, crossings, planted effects, and the structure of a batch."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.operators import sharpe, validation


def threshold_grid(spark: SparkSession, **axes: Sequence[object]) -> DataFrame:
    """Every combination of the settings' values; the axes are literals, so this is as small as it looks."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))
    return out


def summarise(rows: DataFrame, target: float, margin: float) -> DataFrame:
    """(rule, worst_fdr, mean_power, null_any_false, worst_false, safe) of (rule, n_real, sharpe, discoveries, true, false).

    Runs are averaged within a setting first, then settings within a rule; ``null_any_false`` is that of the setting
    with the fewest real ones.
    """
    run = rows.withColumn("fdp", F.col("false") / F.greatest("discoveries", F.lit(1))).withColumn("power", F.when(F.col("n_real") > 0, F.col("true") / F.col("n_real")))
    setting = run.groupBy("rule", "n_real", "sharpe").agg(F.avg("fdp").alias("fdr"), F.avg("power").alias("power"), F.avg((F.col("false") > 0).cast("double")).alias("any_false"), F.max("false").alias("worst"))
    rule = setting.groupBy("rule").agg(F.max("fdr").alias("worst_fdr"), F.avg("power").alias("mean_power"), F.min_by("any_false", F.struct("n_real", "sharpe")).alias("null_any_false"), F.max("worst").alias("worst_false"))
    return rule.withColumn("safe", F.col("worst_fdr") <= target - margin).orderBy(F.desc("safe"), F.desc("mean_power"), "rule")


def recommend(results: DataFrame, target: float, *, design: str = "reuse") -> DataFrame:
    """Threshold sets whose mean FDR is at most the target in every setting, most powerful first."""
    rows = results.where((F.col("arm") == "funnel") & (F.col("design") == design))
    setting = rows.groupBy("thresholds", "share_real", "sharpe_real").agg(F.avg("fdr").alias("fdr"), F.avg("power").alias("power"))
    out = setting.groupBy("thresholds").agg(F.max("fdr").alias("worst_fdr"), F.avg("power").alias("mean_power"))
    return out.where(F.col("worst_fdr") <= target).orderBy(F.desc("mean_power"), "thresholds")


def gates_alone(stages: DataFrame, truth: DataFrame, gates: Sequence[str]) -> DataFrame:
    """(truth, one pass rate for each gate), each gate as if it stood alone."""
    return stages.join(truth, "family").groupBy("truth").agg(*[F.avg(F.col(g).cast("double")).alias(g) for g in gates])


def crossing(curves: DataFrame, level: float, *, keys: Sequence[str] = (), x: str = "sharpe", y: str = "power") -> DataFrame:
    """(keys, at): where the running maximum of y first reaches the level, between grid points by a line; null if never."""
    run = Window.partitionBy(*keys).orderBy(x)
    top = curves.withColumn("_m", F.max(y).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    placed = top.withColumn("_x0", F.lag(x).over(run)).withColumn("_y0", F.lag("_m").over(run))
    at = F.when(F.col("_x0").isNull(), F.col(x)).otherwise(F.col("_x0") + (F.lit(level) - F.col("_y0")) * (F.col(x) - F.col("_x0")) / (F.col("_m") - F.col("_y0")))
    hit = placed.withColumn("_hit", F.col("_m") >= level)
    return hit.groupBy(*keys).agg(F.min_by(F.when(F.col("_hit"), at), F.when(F.col("_hit"), F.col(x))).alias("at"))


def plant(returns: DataFrame, targets: DataFrame, annual_sharpe: float, *, periods: int = 252) -> DataFrame:
    """Returns with the mean of the target variants moved to a given annual Sharpe ratio, their spread unchanged."""
    stats = returns.join(targets, "candidate", "left_semi").groupBy("candidate").agg(F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"))
    moved = returns.join(stats, "candidate", "left")
    return moved.withColumn("ret", F.when(F.col("_sd").isNotNull(), F.col("ret") - F.col("_mean") + F.col("_sd") * annual_sharpe / math.sqrt(periods)).otherwise(F.col("ret"))).drop("_mean", "_sd")


def measure(returns: DataFrame) -> DataFrame:
    """One row on the structure of (date, candidate, family, ret): counts, correlations within and across families, quartiles of
    observations, idle share and runs, autocorrelation and excess kurtosis."""
    family = returns.select("candidate", "family").distinct()
    pairs = sharpe.pair_correlations(returns.select("date", "candidate", "ret"))
    known = pairs.join(family.select(F.col("candidate").alias("a"), F.col("family").alias("fa")), "a").join(family.select(F.col("candidate").alias("b"), F.col("family").alias("fb")), "b")
    inside = F.col("fa") == F.col("fb")
    means = known.agg(F.avg(F.when(inside, F.col("r"))).alias("within_corr"), F.avg(F.when(~inside, F.col("r"))).alias("across_corr"))
    rows = Window.partitionBy("candidate").orderBy("date")
    there = returns.where("ret is not null").withColumn("_lag", F.lag("ret").over(rows))
    both = F.col("_lag").isNotNull()
    cov, v1, v2 = F.covar_pop(F.when(both, F.col("ret")), "_lag"), F.var_pop(F.when(both, F.col("ret"))), F.var_pop("_lag")
    shape = there.groupBy("candidate").agg(F.count("ret").alias("days"), F.try_divide(cov, F.sqrt(v1 * v2)).alias("ar1")).join(sharpe.moments(returns.select("date", "candidate", "ret")).select("candidate", (F.try_divide("m4", F.col("m2") * F.col("m2")) - 3).alias("kurtosis")), "candidate")
    live = validation.trim_live(returns.select("date", "candidate", "ret"))
    idle = live.groupBy("candidate").agg(F.avg(F.col("ret").isNull().cast("double")).alias("idle_share")).join(validation.mean_idle_run(live), "candidate", "left")
    each = shape.join(idle, "candidate", "left")
    quartiles = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in ("days", "ar1", "kurtosis", "idle_share", "mean_run")]
    counts = returns.agg(F.countDistinct("family").alias("n_families"), F.countDistinct("candidate").alias("n_variants"), F.countDistinct("date").alias("n_dates"))
    return counts.crossJoin(means).crossJoin(each.agg(*quartiles))
