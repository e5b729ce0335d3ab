"""Named public tables over a landing folder, and deterministic samples for trying things out."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.sources import files

# The published file of each named table. Its header names the columns.
DATASETS = {
    "factors_daily": "F-F_Research_Data_Factors_daily.csv",
    "factors_monthly": "F-F_Research_Data_Factors.csv",
    "factors5_daily": "F-F_Research_Data_5_Factors_2x3_daily.csv",
    "momentum_daily": "F-F_Momentum_Factor_daily.csv",
    "industry49_daily": "49_Industry_Portfolios_daily.csv",
    "industry12_daily": "12_Industry_Portfolios_daily.csv",
}
INDUSTRIES = (12, 49)


def load(spark: SparkSession, dataset: str, landing: str, cache: str | None = None) -> DataFrame:
    """(date, one column a factor) of a named table from the text files in ``landing``, kept as Parquet under ``cache``."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; there are {sorted(DATASETS)}")
    make = lambda: files.factor_table(spark.read.option("encoding", "ISO-8859-1").text(f"{landing}/{DATASETS[dataset]}", wholetext=True))
    return files.cached(spark, f"{cache}/{dataset}.parquet", make) if cache else make()


def with_momentum(factors: DataFrame, momentum: DataFrame) -> DataFrame:
    """Five factors with momentum behind, on the days that both have."""
    order = ["Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF", "Mom"]
    return factors.join(momentum.select("date", "Mom"), "date").select("date", *[F.col(f"`{c}`") for c in order])


def five_with_momentum(spark: SparkSession, landing: str, cache: str | None = None) -> DataFrame:
    """The named tables of the five factors and of momentum, joined."""
    return with_momentum(load(spark, "factors5_daily", landing, cache), load(spark, "momentum_daily", landing, cache))


def industry_returns(spark: SparkSession, n: int, landing: str, cache: str | None = None) -> DataFrame:
    """Daily returns of 12 or 49 industry portfolios, a column each as the file names them."""
    if n not in INDUSTRIES:
        raise ValueError(f"industries come in {INDUSTRIES}")
    return load(spark, f"industry{n}_daily", landing, cache)


def sample_prices(spark: SparkSession, *, start: str = "2025-01-02", days: int = 126, assets: int = 40, seed: int = 20260825) -> DataFrame:
    """(date, asset, open, high, low, close, volume): prices under a market and a sector factor, each asset from the seed and its number."""
    dates = pd.bdate_range(start, periods=days)

    def one(i: int) -> pd.DataFrame:
        market, sector = np.random.default_rng([seed, 0]).normal(0.0003, 0.009, days), np.random.default_rng([seed, 1, i % 8]).normal(0, 0.006, days)
        r = np.random.default_rng([seed, 2, i])
        ret = r.uniform(0.6, 1.4) * market + r.uniform(0.3, 1.0) * sector + r.normal(0, 0.012, days)
        close = r.uniform(20, 400) * np.exp(np.cumsum(ret))
        open_ = np.append(close[0] * math.exp(-ret[0]), close[:-1]) * np.exp(r.normal(0, 0.003, days))
        spread = np.abs(r.normal(0, 0.006, days))
        return pd.DataFrame({"date": dates.date, "asset": f"S{i:03d}", "open": open_, "high": np.maximum(open_, close) * (1 + spread), "low": np.minimum(open_, close) * (1 - spread), "close": close, "volume": np.rint(r.lognormal(13, 0.4, days))})

    def rows(frames):
        for frame in frames:
            for i in frame["id"]:
                yield one(int(i))

    return spark.range(assets, numPartitions=max(1, min(assets, spark.sparkContext.defaultParallelism))).mapInPandas(rows, "date date, asset string, open double, high double, low double, close double, volume double")


def sample_fundamentals(prices: DataFrame, *, quarters: int = 4, seed: int = 20260825) -> DataFrame:
    """(asset, period_end, filed, tag, value): quarterly facts of each asset, filed 30 to 75 days after their quarter, from hashes of the seed."""
    last = prices.groupBy("asset").agg(F.min("date").alias("d"), F.avg("close").alias("level"))
    ends = last.select("asset", "level", F.explode(F.transform(F.sequence(F.lit(1), F.lit(quarters)), lambda q: F.last_day(F.add_months(F.trunc("d", "quarter"), -3 * q + 2)))).alias("period_end"))
    uniform = lambda *k: F.pmod(F.xxhash64(F.lit(seed), *k), F.lit(1 << 30)) / F.lit(float(1 << 30))
    tags = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(s).alias("scale")) for t, s in (("Revenues", 4.0), ("NetIncomeLoss", 0.4), ("Assets", 12.0), ("StockholdersEquity", 5.0))])
    facts = ends.select("asset", "period_end", "level", F.explode(tags).alias("t"))
    filed = F.date_add("period_end", (30 + F.floor(46 * uniform("asset", "period_end"))).cast("int"))
    value = F.round(F.col("level") * F.col("t.scale") * 1e6 * (0.7 + 0.6 * uniform("asset", "period_end", F.col("t.tag"))), 0)
    return facts.select("asset", "period_end", filed.alias("filed"), F.col("t.tag").alias("tag"), value.alias("value"))


def clear_cache(spark: SparkSession, cache: str) -> int:
    """Delete the cached tables of this module; how many there were."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    for dataset in DATASETS:
        path = jvm.org.apache.hadoop.fs.Path(f"{cache}/{dataset}.parquet")
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
