"""Sharpe-ratio inference: robust variance, tests, deflation, track-record length and trial correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions import normal


def newey_west_lags(n: int | Column) -> int | Column:
    """floor(4 (n / 100)^(2/9))."""
    if isinstance(n, Column):
        return F.floor(4.0 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int")
    return math.floor(4.0 * (n / 100.0) ** (2.0 / 9.0))


def moments(returns: DataFrame, *, keys: Sequence[str] = ("candidate",), value: str = "ret") -> DataFrame:
    """n_obs, mean and population central moments m2, m3, m4 of each series; missing values are left out."""
    whole = Window.partitionBy(*keys)
    centred = returns.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(whole))
    flat = F.max(value) == F.min(value)
    power = lambda k: F.when(flat, 0.0).otherwise(F.avg(F.pow("_d", F.lit(float(k)))))
    return centred.groupBy(*keys).agg(F.count(value).alias("n_obs"), F.avg(value).alias("mean"), power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"))


def sharpe_variance(returns: DataFrame, *, method: str = "hac", lags: int | None = None, keys: Sequence[str] = ("candidate",), value: str = "ret") -> DataFrame:
    """keys, n_obs, mean, m2, m3, m4, variance: V of the per-period Sharpe ratio, by "normal", "nonnormal" or "hac".

    For "hac", Bartlett weights over lags of the moments (r - mean, (r - mean)^2 - m2) on the series without its
    gaps, mapped through the delta method. Only the scalar g = gradient . moments enters the result, so the
    long-run variance is that of one series: its lagged products are summed in one pass, a column for each lag up
    to the largest any series needs, weight 0 beyond a series' own.
    """
    if method not in ("normal", "nonnormal", "hac"):
        raise ValueError("method is normal, nonnormal or hac")
    base = moments(returns, keys=keys, value=value)
    sr = F.try_divide(F.col("mean"), F.sqrt("m2"))
    if method != "hac":
        v = 1 + sr * sr / 2 if method == "normal" else 1 - F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5))) * sr + (F.try_divide(F.col("m4"), F.col("m2") * F.col("m2")) - 1) / 4 * sr * sr
        return base.withColumn("variance", F.when((F.col("n_obs") >= 2) & (F.col("m2") > 0), v))
    joined = returns.where(F.col(value).isNotNull()).join(base, list(keys))
    d = F.col(value) - F.col("mean")
    g = d / F.sqrt("m2") - F.col("mean") / (2 * F.pow("m2", F.lit(1.5))) * (d * d - F.col("m2"))
    series = Window.partitionBy(*keys).orderBy("date")
    scored = joined.withColumn("_g", F.when(F.col("m2") > 0, g))
    most = lags if lags is not None else newey_west_lags(int(base.agg(F.max("n_obs")).first()[0] or 2))
    own = F.lit(lags) if lags is not None else newey_west_lags(F.col("n_obs"))
    terms = [(F.col("_g") * F.col("_g")).alias("_p0"), *[(F.col("_g") * F.lag("_g", j).over(series)).alias(f"_p{j}") for j in range(1, most + 1)]]
    summed = scored.select(*keys, *terms).groupBy(*keys).agg(*[F.sum(f"_p{j}").alias(f"_p{j}") for j in range(most + 1)])
    out = base.join(summed, list(keys), "left").withColumn("_l", own)
    total = F.col("_p0")
    for j in range(1, most + 1):
        weight = F.when(F.lit(j) <= F.least(F.col("_l"), F.col("n_obs") - 1), 1 - F.lit(j) / (F.col("_l") + 1.0)).otherwise(0.0)
        total = total + 2 * weight * F.coalesce(f"_p{j}", F.lit(0.0))
    return out.withColumn("variance", F.when((F.col("n_obs") >= 2) & (F.col("m2") > 0), total / F.col("n_obs"))).select(*keys, "n_obs", "mean", "m2", "m3", "m4", "variance")


def sharpe_test(returns: DataFrame, *, method: str = "hac", benchmark: float = 0.0, lags: int | None = None, periods: int = 252, keys: Sequence[str] = ("candidate",), value: str = "ret") -> DataFrame:
    """keys, n_obs, sharpe, skew, kurtosis, variance, se, pvalue, pvalue_greater, psr; Sharpe and se are annual."""
    v = sharpe_variance(returns, method=method, lags=lags, keys=keys, value=value)
    live = F.col("m2") > 0
    shaped = v.select(
        *keys, "n_obs", "variance",
        F.when(live, F.col("mean") / F.sqrt("m2") * math.sqrt(periods)).alias("sharpe"),
        F.when(live, F.col("m3") / F.pow("m2", F.lit(1.5))).alias("skew"),
        F.when(live, F.col("m4") / (F.col("m2") * F.col("m2"))).alias("kurtosis"),
        F.when(live & (F.col("n_obs") > 1), F.sqrt(F.col("variance") / (F.col("n_obs") - 1) * periods)).alias("se"),
    )
    z = shaped.withColumn("_z", F.try_divide(F.col("sharpe") - benchmark, F.col("se"))).withColumn("_az", F.abs("_z"))
    return z.withColumn("pvalue", 2 * F.expr(normal.sf_sql("_az"))).withColumn("pvalue_greater", F.expr(normal.sf_sql("_z"))).withColumn("psr", 1 - F.col("pvalue_greater")).drop("_z", "_az")


def expected_max_sharpe(n_trials: float, n_obs: int, periods: int = 252, *, variance: float | None = None) -> float:
    """Expected largest Sharpe ratio of unskilled trials; their variance is 1 / n_obs a period unless given."""
    spread = math.sqrt(variance) if variance is not None else 1 / math.sqrt(n_obs)
    return normal.expected_max(n_trials) * spread * math.sqrt(periods)


def deflated(tests: DataFrame, n_trials: float, *, periods: int = 252, name: str = "dsr") -> DataFrame:
    """Adds the probability that a Sharpe ratio beats the expected best of ``n_trials``, for rows of :func:`sharpe_test`."""
    best = F.lit(normal.expected_max(n_trials)) / F.sqrt(F.col("n_obs").cast("double")) * math.sqrt(periods)
    placed = tests.withColumn("_b", best)
    return placed.withColumn(name, F.expr(normal.psr_sql("sharpe", "n_obs", "_b", "variance", periods))).drop("_b")


def min_track_record(tests: DataFrame, *, benchmark: float = 0.0, alpha: float = 0.05, periods: int = 252, name: str = "min_trl") -> DataFrame:
    """Observations needed for significance: 1 + V (z / (sr - sr*))^2; infinite where the ratio isn't above the benchmark."""
    z = normal.ppf(1 - alpha)
    gap = (F.col("sharpe") - benchmark) / math.sqrt(periods)
    return tests.withColumn(name, F.when(F.col("sharpe").isNull(), None).when(gap <= 0, F.lit(float("inf"))).otherwise(1 + F.col("variance") * F.pow(F.lit(z) / gap, F.lit(2.0))))


def pair_correlations(returns: DataFrame, *, key: str = "candidate", value: str = "ret") -> DataFrame:
    """(a, b, n, r) for each pair a < b: Pearson correlation over their common dates; null where undefined.

    Sums over the self-join on date; candidates are the small side of this table and meet only within a date.
    """
    rows = returns.where(F.col(value).isNotNull()).select("date", key, value)
    one = rows.select("date", F.col(key).alias("a"), F.col(value).alias("x"))
    two = rows.select("date", F.col(key).alias("b"), F.col(value).alias("y"))
    met = one.join(two, "date").where("a < b").groupBy("a", "b")
    sums = met.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("_c"), F.var_pop("x").alias("_x"), F.var_pop("y").alias("_y"))
    return sums.select("a", "b", "n", F.try_divide("_c", F.sqrt(F.col("_x") * F.col("_y"))).alias("r"))


def average_correlation(returns: DataFrame, *, key: str = "candidate", value: str = "ret") -> DataFrame:
    """One row: the mean pairwise correlation, undefined pairs left out."""
    return pair_correlations(returns, key=key, value=value).agg(F.avg("r").alias("avg_correlation"))


def implied_trials(n_trials: float, correlation: float) -> float:
    """Independent trials that correlated ones amount to: rho + (1 - rho) n."""
    rho = max(correlation, 0.0)
    return rho + (1 - rho) * n_trials


def sharpe_threshold(n_obs: int, rho: float = 0.0, alpha: float = 0.05) -> float:
    """Two-sided threshold of a per-period Sharpe ratio whose returns are AR(1)."""
    return normal.ppf(1 - alpha / 2) * math.sqrt((1 + rho) / (1 - rho) / n_obs)


def fdr(alpha: float, beta: float, pi0: float) -> float:
    """Share of false among rejected: alpha pi0 over all rejections."""
    return alpha * pi0 / (alpha * pi0 + (1 - beta) * (1 - pi0))


def familywise_errors(alpha: float, beta: float, pi0: float, k: int) -> dict[str, float]:
    """Errors of the best of k tried: alpha_k, beta_k and pi0_k."""
    pi0_k = pi0**k
    mix = alpha * pi0 + (1 - beta) * (1 - pi0)
    alpha_k = 1 - (1 - alpha) ** k
    any_hit = 1 - (1 - mix) ** k
    real_hit = (any_hit - alpha_k * pi0_k) / (1 - pi0_k) if pi0_k < 1 else 1 - beta
    return {"alpha_k": alpha_k, "beta_k": 1 - real_hit, "pi0_k": pi0_k}


def with_search_errors(rows: DataFrame, alpha: float, beta: float, *, pi0: str = "pi0", k: str = "k") -> DataFrame:
    """``rows`` (share of true nulls, number tried) with fdr, alpha_k, beta_k and fdr_k: errors of a single test and of the best of k, as columns.

    Where all are null, beta_k is that of a single test.
    """
    p, n = F.col(pi0), F.col(k).cast("double")
    mix = alpha * p + (1 - beta) * (1 - p)
    none_found = lambda share: F.pow(1 - share, n)
    all_null = F.pow(p, n)
    alpha_k = 1 - none_found(F.lit(alpha))
    hit = F.when(all_null < 1, (1 - none_found(mix) - alpha_k * all_null) / (1 - all_null)).otherwise(1 - beta)
    out = rows.withColumn("fdr", alpha * p / mix).withColumn("alpha_k", alpha_k).withColumn("beta_k", 1 - hit)
    return out.withColumn("fdr_k", F.col("alpha_k") * all_null / (F.col("alpha_k") * all_null + (1 - F.col("beta_k")) * (1 - all_null)))


def search_adjusted_fdr(alpha: float, beta: float, pi0: float, k: int) -> float:
    e = familywise_errors(alpha, beta, pi0, k)
    return fdr(e["alpha_k"], e["beta_k"], e["pi0_k"])
