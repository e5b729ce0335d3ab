"""Truth-known data: panels with planted signals, return series with defects, and families of variants.

Numbers come from numpy generators seeded for each candidate, so a row depends on the seed and its candidate and
never on how candidates are dealt over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _each(spark: SparkSession, n: int, make, schema: str) -> DataFrame:
    """``make`` on each of n numbers, spread over the cluster."""

    def rows(batches):
        for pdf in batches:
            for i in pdf["id"]:
                yield make(int(i))

    return spark.range(n, numPartitions=max(1, min(n, spark.sparkContext.defaultParallelism * 2))).mapInPandas(rows, schema)


def planted(n: int, n_real: int, seed: int) -> np.ndarray:
    """The numbers of the real ones among n, drawn at random."""
    return np.sort(np.random.default_rng([seed, 7]).choice(n, n_real, replace=False))


def _truth(spark: SparkSession, n: int, real: np.ndarray) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("candidate"), F.col("id").isin([int(i) for i in real]).alias("truth"))


def make_panel(spark: SparkSession, *, n_dates: int = 2520, n_assets: int = 100, n_candidates: int = 200, n_real: int = 0, effect: float = 0.02, vol: float = 0.015, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(signals, truth): long (candidate, date, asset, signal, ret), where real candidates lead the next return by a correlation of ``effect``."""
    if not 0 <= n_real <= n_candidates or not -1 <= effect <= 1:
        raise ValueError("n_real or effect out of range")
    days = pd.bdate_range("2000-01-03", periods=n_dates).date
    real = planted(n_candidates, n_real, seed)

    def one(i: int) -> pd.DataFrame:
        ret = np.random.default_rng([seed, 0]).normal(scale=vol, size=(n_dates, n_assets))
        signal = np.random.default_rng([seed, 1, i]).normal(size=(n_dates, n_assets))
        if i in real:
            ahead = np.vstack([ret[1:], np.random.default_rng([seed, 2, i]).normal(scale=vol, size=(1, n_assets))]) / vol
            signal = effect * ahead + math.sqrt(1 - effect**2) * signal
        return pd.DataFrame({"candidate": i, "date": np.repeat(days, n_assets), "asset": np.tile(np.arange(n_assets), n_dates), "signal": signal.ravel(), "ret": ret.ravel()})

    truth = _truth(spark, n_candidates, real)
    return _each(spark, n_candidates, one, "candidate int, date date, asset int, signal double, ret double"), truth


def shocks(n: int, rng: np.random.Generator, t_df: float | None) -> np.ndarray:
    """Normal or, with ``t_df``, fat-tailed shocks of variance 1."""
    return rng.normal(size=n) if t_df is None else rng.standard_t(t_df, size=n) * math.sqrt((t_df - 2) / t_df)


def series(n: int, rng: np.random.Generator, common: np.ndarray, *, rho: float = 0.0, ar1: float = 0.0, t_df: float | None = None, garch: tuple[float, float] | None = None) -> np.ndarray:
    """Standardised returns: part common, fat-tailed, clustered, autocorrelated; each step keeps mean 0 and variance 1."""
    own = shocks(n, rng, t_df)
    x = math.sqrt(rho) * common + math.sqrt(1 - rho) * own
    if garch is not None:
        a, b = garch
        var, out = 1.0, np.empty(n)
        for t in range(n):
            out[t] = x[t] * math.sqrt(var)
            var = 1 - a - b + a * out[t] ** 2 + b * var
        x = out
    if ar1:
        out = np.empty(n)
        out[0] = x[0]
        for t in range(1, n):
            out[t] = ar1 * out[t - 1] + math.sqrt(1 - ar1 * ar1) * x[t]
        x = out
    return x


def make_return_matrix(spark: SparkSession, *, n_obs: int = 2520, n_candidates: int = 200, n_real: int = 0, sharpe_real: float = 1.0, vol: float = 0.01, rho: float = 0.0, ar1: float = 0.0, t_df: float | None = None, garch: tuple[float, float] | None = None, periods: int = 252, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(returns, truth): long (candidate, date, ret), equally correlated by rho, real ones with the given Sharpe ratio."""
    days = pd.bdate_range("2000-01-03", periods=n_obs).date
    real = planted(n_candidates, n_real, seed)

    def one(i: int) -> pd.DataFrame:
        common = shocks(n_obs, np.random.default_rng([seed, 0]), t_df)
        x = series(n_obs, np.random.default_rng([seed, 1, i]), common, rho=rho, ar1=ar1, t_df=t_df, garch=garch)
        drift = sharpe_real / math.sqrt(periods) if i in real else 0.0
        return pd.DataFrame({"candidate": i, "date": days, "ret": vol * (x + drift)})

    truth = _truth(spark, n_candidates, real)
    return _each(spark, n_candidates, one, "candidate int, date date, ret double"), truth


def idle_days(n: int, share: float, run: float, rng: np.random.Generator) -> np.ndarray:
    """A two-state chain that is idle a given share of days, in runs of a given mean length."""
    if share <= 0:
        return np.zeros(n, bool)
    leave = 1 / run
    enter = leave * share / (1 - share)
    out, state = np.empty(n, bool), rng.random() < share
    for t, u in enumerate(rng.random(n)):
        out[t] = state
        state = (u >= leave) if state else (u < enter)
    return out


def make_family_set(spark: SparkSession, n_families: int, k: int, share_real: float, sharpe_real: float, *, within_rho: float = 0.9, n_obs: int = 36 * 252, seed: int = 0, idle_share: float = 0.0, idle_run: float = 21.0, periods: int = 252, **defects) -> tuple[DataFrame, DataFrame]:
    """(returns, truth): families of k near copies, (date, candidate, family, pos, ret), with idle days as nulls."""
    days = pd.bdate_range("1990-01-01", periods=n_obs).date
    real = planted(n_families, round(share_real * n_families), seed)

    def one(f: int) -> pd.DataFrame:
        common = shocks(n_obs, np.random.default_rng([seed, 0, f]), defects.get("t_df"))
        idle = idle_days(n_obs, idle_share, idle_run, np.random.default_rng([seed, 2, f]))
        frames = []
        for v in range(k):
            x = series(n_obs, np.random.default_rng([seed, 1, f, v]), common, rho=within_rho, **defects)
            ret = 0.01 * (x + (sharpe_real / math.sqrt(periods) if f in real else 0.0))
            frames.append(pd.DataFrame({"date": days, "candidate": f"f{f}v{v}", "family": f"f{f}", "pos": v, "ret": np.where(idle, np.nan, ret)}))
        return pd.concat(frames)

    truth = spark.range(n_families).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("family"), F.col("id").isin([int(i) for i in real]).alias("truth"))
    made = _each(spark, n_families, one, "date date, candidate string, family string, pos int, ret double")
    return made.withColumn("ret", F.when(~F.isnan("ret"), F.col("ret"))), truth


def bootstrap_from_real(returns: DataFrame, n_candidates: int = 200, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(panel, signals): real dates resampled once, whole dates together, as (date, asset, ret), and noise signals (candidate, date, asset, signal) on it.

    Only dates are numbered in one place; returns are moved once by a join on them.
    """
    from pyspark.sql import Window

    spark = returns.sparkSession
    dates = returns.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    n = dates.count()
    picks = dates.select("date", F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(n)).cast("int").alias("from"))
    sources = dates.select(F.col("date").alias("source"), F.col("i").alias("from"))
    panel = picks.join(sources, "from").join(returns.withColumnRenamed("date", "source"), "source").select("date", "asset", "ret")
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "candidate", "date", "asset"), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    noise = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    cells = panel.select("date", "asset").crossJoin(F.broadcast(spark.range(n_candidates).select(F.col("id").cast("int").alias("candidate"))))
    return panel, cells.select("candidate", "date", "asset", noise.alias("signal"))


def simulate_family_winners(n_families: int, k: int, share_real: float, sharpe_real: float, n_obs: int, *, within_rho: float = 0.0, periods: int = 252, seed: int = 0) -> pd.DataFrame:
    """The best of k statistics for each family, and whether a variant was real."""
    rng = np.random.default_rng(seed)
    real = rng.random((n_families, k)) < share_real
    z = math.sqrt(within_rho) * rng.normal(size=(n_families, 1)) + math.sqrt(1 - within_rho) * rng.normal(size=(n_families, k))
    z = z + real * sharpe_real / math.sqrt(periods) * math.sqrt(n_obs)
    return pd.DataFrame({"family": np.arange(n_families), "z": z.max(axis=1), "truth": real.any(axis=1)})
