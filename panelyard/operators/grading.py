"""Graded scores of families beside their decisions: reported only, no gate reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators import haircut, local_fdr, multiple_testing, sharpe

#: Families below which no local false discovery rate is given.
LEAST_FAMILIES = 200


def family_lfdr(families: DataFrame, *, p: str = "p1", name: str = "lfdr") -> DataFrame:
    """The local false discovery rate of each family's p-value; null throughout below ``LEAST_FAMILIES`` p-values."""
    if families.where(F.col(p).isNotNull()).count() < LEAST_FAMILIES:
        return families.withColumn(name, F.lit(None).cast("double"))
    return local_fdr.local_fdr(families, p=p, name=name)


def haircuts(tests: DataFrame, n_trials: int, avg_correlation: float | None, *, seed: int = 0, n_simulations: int = 2000, key: str = "family") -> DataFrame:
    """(key, haircut_sharpe): the least of the three adjusted daily ratios, null where undefined or with under two trials."""
    if n_trials < 2:
        return tests.select(key, F.lit(None).cast("double").alias("haircut_sharpe"))
    rho = 0.2 if avg_correlation is None else min(max(avg_correlation, 0.0), 0.99)
    cut = haircut.haircut_sharpe(tests.select(key, "sharpe", "n_obs"), n_trials, frequency="daily", avg_correlation=rho, n_simulations=n_simulations, seed=seed, key=key)
    return cut.select(key, F.least(*[f"sharpe_{m}" for m in haircut.METHODS]).alias("haircut_sharpe"))


def graded_scores(returns: DataFrame, best: DataFrame, n_trials: int, avg_correlation: float | None, *, seed: int = 0, n_simulations: int = 2000, periods: int = 252) -> DataFrame:
    """For each (family, candidate, p1) of ``best``: p1, by, holm, lfdr, sharpe, psr, min_trl_years, haircut_sharpe.

    ``returns`` are (candidate, date, ret) of the search period.
    """
    tests = sharpe.min_track_record(sharpe.sharpe_test(returns.join(best.select("candidate"), "candidate", "left_semi"), periods=periods), periods=periods)
    scored = family_lfdr(multiple_testing.all_adjusted(best, p="p1"))
    joined = scored.join(tests.select("candidate", "sharpe", "psr", "n_obs", (F.col("min_trl") / periods).alias("min_trl_years")), "candidate", "left")
    return joined.join(haircuts(joined, n_trials, avg_correlation, seed=seed, n_simulations=n_simulations), "family", "left").drop("n_obs")


def search_fdr(families: DataFrame, *, p: str = "p1", passed: str = "passed") -> DataFrame:
    """One row (estimate): Storey's positive FDR of the rejections up to the largest passing p, at most 1; null when nothing passed."""
    cut = families.where(F.col(passed) & F.col(p).isNotNull()).agg(F.max(p).alias("t"))
    all_ = families.where(F.col(p).isNotNull()).crossJoin(F.broadcast(cut))
    sums = all_.agg(F.first("t").alias("t"), F.count("*").alias("m"), F.count_if(F.col(p) > 0.5).alias("above"), F.count_if(F.col(p) <= F.greatest("t", F.lit(0.0))).alias("r"))
    pi0 = F.least(F.lit(1.0), F.col("above") / (0.5 * F.col("m")))
    share = F.greatest(F.col("r") / F.col("m"), 1 / F.col("m"))
    value = F.when(F.col("t") <= 0, F.least(F.lit(1.0), pi0 / F.greatest("r", F.lit(1)))).otherwise(pi0 * F.col("t") / (share * (1 - F.pow(1 - F.col("t"), F.col("m")))))
    return sums.select(F.when(F.col("t").isNotNull(), value).alias("estimate"))


def stage4_statistic(stats: DataFrame, *, final: str = "bh", n_trials: int | None = None, alive: str = "stage3", prefix: str = "ho_", periods: int = 252, name: str = "stage4_stat") -> DataFrame:
    """What the last gate compares: adjusted holdout p-values of the survivors (a missing one counts as 1), or deflated ratios; null for the rest."""
    living = stats.where(alive)
    if final == "bh":
        found = multiple_testing.bh_adjusted(living.select("family", F.coalesce(F.col(f"{prefix}p"), F.lit(1.0)).alias("_p")), p="_p", name=name).select("family", name)
    else:
        tests = living.where(F.col(f"{prefix}n_obs") > 0).select("family", *[F.col(prefix + c).alias(c) for c in ("sharpe", "n_obs", "skew", "kurtosis", "variance")])
        found = sharpe.deflated(tests, n_trials or max(1, living.count()), periods=periods, name=name).select("family", name)
    return stats.join(found, "family", "left")


def expected_mean(haircut_sharpe: Column, sharpe_: Column, search_mean: Column, holdout_mean: Column) -> Column:
    """The least of the search mean cut in proportion, the holdout mean and the search mean; missing ones are passed over."""
    ratio = F.greatest(F.try_divide(haircut_sharpe, sharpe_), F.lit(0.0))
    cut = F.when(haircut_sharpe.isNotNull() & sharpe_.isNotNull(), search_mean * ratio)
    return F.least(cut, holdout_mean, search_mean)
