"""Splits in time and overfitting: purged folds, walk-forward windows, label uniqueness, and combinatorial cross-validation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(dates: DataFrame) -> DataFrame:
    """(date, i, n): position from 0, and the number of dates."""
    return dates.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))


def embargo_size(n_labelled: int, horizon: int, pct: float) -> int:
    return max(horizon, math.ceil(pct * n_labelled))


def purged_kfold(dates: DataFrame, k: int, horizon: int, *, embargo_pct: float = 0.0) -> DataFrame:
    """(fold, date, role): contiguous test folds over the dates that have a label, and the training dates each leaves.

    A date's label runs over (t, t + horizon]. Training dates whose label overlaps a test label's are purged, and the
    embargo's dates from the last test label's end on too; it is never shorter than the horizon. Folds are few, so they are one side of a join
    against positions, and every comparison is on integers.
    """
    placed = positions(dates).where(F.col("i") < F.col("n") - horizon)
    labelled = placed.withColumn("m", F.col("n") - horizon).withColumn("fold", F.ntile(k).over(Window.orderBy("i")) - 1)
    spans = labelled.groupBy("fold").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.first("m").alias("m"))
    spans = spans.withColumn("gap", F.greatest(F.lit(horizon), F.ceil(F.lit(embargo_pct) * F.col("m"))).cast("int"))
    both = labelled.select("date", "i").crossJoin(F.broadcast(spans))
    test = F.col("i").between(F.col("lo"), F.col("hi"))
    before = F.col("i") + horizon <= F.col("lo")
    after = F.col("i") >= F.col("hi") + horizon + F.col("gap")
    return both.withColumn("role", F.when(test, "test").when(before | after, "train")).where("role is not null").select("fold", "date", "role")


def walk_forward(dates: DataFrame, *, n_splits: int = 4, test_size: int | None = None, train_size: int | None = None, horizon: int = 1, gap: int = 0, min_train: int = 1) -> DataFrame:
    """(fold, date, role): the last labelled dates in ``n_splits`` test windows that follow one another.

    Training dates end where their labels are realised before the window, less ``gap``; all of them, or the last
    ``train_size``.
    """
    placed = positions(dates)
    n = placed.count() - horizon
    size = test_size if test_size is not None else n // (n_splits + 1)
    first = n - n_splits * size
    if size < 1 or first < 1 or first - horizon - gap + 1 < min_train:
        raise ValueError("too few labelled dates for these windows")
    starts = dates.sparkSession.range(n_splits).select(F.col("id").cast("int").alias("fold"), (F.lit(first) + F.col("id") * size).cast("int").alias("lo"))
    both = placed.where(F.col("i") < n).crossJoin(F.broadcast(starts))
    test = (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("lo") + size)
    train = F.col("i") <= F.col("lo") - horizon - gap
    if train_size is not None:
        train = train & (F.col("i") > F.col("lo") - horizon - gap - train_size)
    return both.withColumn("role", F.when(test, "test").when(train, "train")).where("role is not null").select("fold", "date", "role")


def average_uniqueness(labels: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, uniqueness): mean over a label's span (date, t1] of one over the labels that are open on each date."""
    at = positions(dates).select(F.col("date").alias("_d"), "i")
    spans = labels.join(at.withColumnRenamed("i", "a"), F.col("date") == F.col("_d")).drop("_d").join(at.withColumnRenamed("i", "b"), F.col("t1") == F.col("_d")).drop("_d")
    open_on = spans.where("b > a").select("date", F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("j"))
    many = open_on.withColumn("_c", F.count("*").over(Window.partitionBy("j")))
    return many.groupBy("date").agg(F.avg(F.lit(1.0) / F.col("_c")).alias("uniqueness"))


FLAT = 1e-10


def block_moments(returns: DataFrame, n_blocks: int, *, key: str = "candidate", value: str = "ret") -> DataFrame:
    """(key, block, s, q, n): sums over equal blocks of neighbouring dates; dates where a series has no value, and a rest at the end, are left out."""
    everyone = returns.select(F.countDistinct(key)).first()[0]
    whole = returns.where(F.col(value).isNotNull()).groupBy("date").agg(F.countDistinct(key).alias("c")).where(F.col("c") == everyone)
    placed = positions(whole)
    size = F.floor(F.col("n") / n_blocks)
    blocks = placed.withColumn("block", F.floor(F.col("i") / size).cast("int")).where(F.col("block") < n_blocks)
    rows = returns.join(F.broadcast(blocks.select("date", "block")), "date")
    return rows.groupBy(key, "block").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count(value).alias("n"))


def _moment_sharpe(s: str, q: str, n: str, periods: int):
    mean, second = F.col(s) / F.col(n), F.col(q) / F.col(n)
    var = second - mean * mean
    return F.when((F.col(n) > 1) & (var * F.col(n) / (F.col(n) - 1) > FLAT * second), mean / F.sqrt(var * F.col(n) / (F.col(n) - 1)) * math.sqrt(periods))


def cscv_splits(returns: DataFrame, n_blocks: int = 16, *, periods: int = 252, key: str = "candidate", value: str = "ret") -> DataFrame:
    """(mask, winner, is_sharpe, oos_sharpe, rank): for each half of the blocks, the best candidate inside and its place outside.

    Returns are first reduced to block moments; a split then is a bit mask, its halves are sums over blocks, and no
    date is read again. ``rank`` is the winner's place outside, from 0 (worst) to 1, with average ties.
    """
    if n_blocks % 2 or n_blocks < 2:
        raise ValueError("n_blocks must be even")
    parts = block_moments(returns, n_blocks, key=key, value=value)
    wide = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", "s", "q", "n"))).alias("b"))
    spark = returns.sparkSession
    masks = spark.range(1 << n_blocks).where(F.bit_count("id") == n_blocks // 2).select(F.col("id").alias("mask"))
    half = lambda c, inside: F.aggregate("b", F.lit(0.0), lambda t, x: t + F.when((F.call_function("shiftright", F.col("mask"), x["block"]).bitwiseAND(F.lit(1)) == int(inside)), x[c].cast("double")).otherwise(0.0))
    both = masks.crossJoin(F.broadcast(wide))
    sums = both.select("mask", key, *[half(c, i).alias(f"{c}{int(i)}") for c in ("s", "q", "n") for i in (True, False)])
    scored = sums.select("mask", key, _moment_sharpe("s1", "q1", "n1", periods).alias("is_sharpe"), _moment_sharpe("s0", "q0", "n0", periods).alias("oos_sharpe"))
    split = Window.partitionBy("mask")
    ties = Window.partitionBy("mask", "_o")
    low = F.lit(float("-inf"))
    ranked = scored.withColumn("_o", F.coalesce("oos_sharpe", low)).select(
        "*",
        F.row_number().over(split.orderBy(F.coalesce("is_sharpe", low).desc(), key)).alias("_best"),
        (F.rank().over(split.orderBy("_o")) + (F.count("*").over(ties) - 1) / 2).alias("_r"),
        F.count("*").over(split).alias("_m"),
    )
    return ranked.where("_best = 1 and is_sharpe is not null").select("mask", F.col(key).alias("winner"), "is_sharpe", "oos_sharpe", (F.col("_r") / (F.col("_m") + 1)).alias("rank"))


def pbo(splits: DataFrame) -> DataFrame:
    """One row: pbo (a rank on the median counts half), n_splits, and the degradation line of outside on inside Sharpe ratios."""
    below = F.when(F.col("rank") < 0.5, 1.0).when(F.col("rank") == 0.5, 0.5).otherwise(0.0)
    spread = F.max("is_sharpe") > F.min("is_sharpe")
    return splits.agg(
        F.avg(below).alias("pbo"),
        F.count("*").alias("n_splits"),
        F.when(spread, F.regr_slope("oos_sharpe", "is_sharpe")).alias("slope"),
        F.when(spread, F.regr_intercept("oos_sharpe", "is_sharpe")).alias("intercept"),
        F.avg((F.col("oos_sharpe") < 0).cast("double")).alias("loss_share"),
    )


def trim_live(series: DataFrame, *, keys: Sequence[str] = ("candidate",), value: str = "ret") -> DataFrame:
    """Rows between each series' first and last value."""
    whole = Window.partitionBy(*keys)
    held = F.when(F.col(value).isNotNull(), F.col("date"))
    return series.withColumn("_a", F.min(held).over(whole)).withColumn("_b", F.max(held).over(whole)).where("date between _a and _b").drop("_a", "_b")


def mean_idle_run(series: DataFrame, *, keys: Sequence[str] = ("candidate",), value: str = "ret") -> DataFrame:
    """Mean length of runs of missing values: gaps and islands by the difference of two row numbers."""
    rows = Window.partitionBy(*keys).orderBy("date")
    numbered = series.withColumn("_i", F.row_number().over(rows)).where(F.col(value).isNull())
    islands = numbered.withColumn("_g", F.col("_i") - F.row_number().over(rows)).groupBy(*keys, "_g").count()
    return islands.groupBy(*keys).agg(F.avg("count").alias("mean_run"), F.count("*").alias("runs"))
