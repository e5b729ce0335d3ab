"""Sharpe ratios cut for the size of the search, by simulated families of other trials.

Every repetition of the simulation is a row of a table that is dealt over the cluster; a repetition draws its other
trials once and places all reported p-values among them. Conventions are those of the published procedure: monthly
units, a daily year of 360 days, two-sided p-values, t for the reported ratio and normal for the simulated ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import normal

#: Fixed values of the published procedure: average correlation, trials, share without a mean, mean of the others.
LEVELS = (
    (0.0, 1295, 0.39660, 0.0054995),
    (0.2, 1377, 0.44589, 0.0055508),
    (0.4, 1476, 0.48604, 0.0055413),
    (0.6, 1773, 0.59902, 0.0055512),
    (0.8, 3109, 0.83901, 0.0055956),
)
YEAR = {"daily": 360, "weekly": 52, "monthly": 12, "quarterly": 4, "annual": 1}
#: Monthly volatility and months of a simulated trial.
VOLATILITY, MONTHS = 0.15 / math.sqrt(12), 240
METHODS = ("bonferroni", "holm", "bhy")


def parameters(correlation: float) -> tuple[float, float, float]:
    """(rho, share without a mean, mean of the others) at an average correlation; outside [0, 1) that of 0.2, above 0.8 extrapolated."""
    if not 0 <= correlation < 1:
        level = LEVELS[1]
        return level[0], level[2], level[3]
    i = min(int(correlation / 0.2), 3)
    w = (correlation - LEVELS[i][0]) / 0.2
    return tuple((1 - w) * LEVELS[i][c] + w * LEVELS[i + 1][c] for c in (0, 2, 3))


def other_trials(n: int, rho: float, null_share: float, mean: float, rng: np.random.Generator) -> np.ndarray:
    """Sorted two-sided p-values of n simulated trials: one common normal shock, and a mean for those that have one."""
    shock = math.sqrt(rho) * rng.standard_normal() + math.sqrt(1 - rho) * rng.standard_normal(n)
    drift = np.where(rng.random(n) > null_share, rng.exponential(mean, n), 0.0) / (VOLATILITY / math.sqrt(MONTHS))
    return np.sort(2 * normal.sf_array(np.abs(drift + shock)))


def adjusted_among(p: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Holm, Benjamini-Yekutieli) values of each reported p, alone among sorted others; the largest p stays unscaled in the second."""
    m = len(others) + 1
    at = np.searchsorted(others, p, side="left")
    down = np.maximum.accumulate(np.append(0.0, (m - np.arange(m - 1)) * others))
    holm = np.minimum(np.maximum(down[at], (m - at) * p), 1.0)
    scale = m * (1 / np.arange(1, m + 1)).sum() / np.arange(1, m + 1)
    scale[-1] = 1.0
    up = np.append(np.minimum.accumulate((scale[1:] * others)[::-1])[::-1], np.inf)
    return holm, np.minimum(scale[at] * p, up[at])


def _t(f, *args: Column) -> Column:
    @F.pandas_udf("double")
    def values(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(d) else f(float(a), float(d)) for a, d in zip(x, df, strict=True)], dtype="float64")

    return values(*args)


def annual_factor(autocorrelation: float, frequency: str) -> float:
    """What first-order autocorrelation does to an annual Sharpe ratio."""
    r, q = autocorrelation, YEAR[frequency]
    if not r or frequency == "annual":
        return 1.0
    return (1 + (2 * r / (1 - r)) * (1 - (1 - r**q) / (q * (1 - r)))) ** -0.5


def haircut_sharpe(
    rows: DataFrame, n_trials: int, *, frequency: str = "monthly", annualized: bool = True, autocorrelation: float = 0.0, avg_correlation: float = 0.2, n_simulations: int = 2000, seed: int = 0, key: str = "candidate"
) -> DataFrame:
    """For each (key, sharpe, n_obs): the annual ratio and p-value, and p-value, ratio and haircut by each method and their average.

    ``n_trials`` counts the reported strategy too: Bonferroni takes the other trials, the others the whole family. A
    ratio that isn't positive has nulls throughout. The reported p-values travel with the function, 16 bytes each,
    so they must be the bounded set of strategies that are reported; the others are drawn where they are used.
    """
    if frequency not in YEAR:
        raise ValueError(f"unknown frequency {frequency!r}")
    if n_trials < 2 or n_simulations < 1 or not -1 < autocorrelation < 1:
        raise ValueError("n_trials, n_simulations or autocorrelation out of range")
    factor = annual_factor(autocorrelation, frequency) * (1.0 if annualized else math.sqrt(YEAR[frequency]))
    months = F.floor(F.col("n_obs") * 12 / F.lit(YEAR[frequency]))
    ready = rows.withColumn("_m", months).withColumn("_a", F.col("sharpe") * F.lit(factor)).withColumn("_a", F.when((F.col("_a") > 0) & (F.col("_m") >= 2), F.col("_a")))
    ready = ready.withColumn("pvalue", 2 * _t(normal.t_sf, F.col("_a") / F.lit(math.sqrt(12)) * F.sqrt("_m"), F.col("_m") - 1))
    distinct = [r["pvalue"] for r in ready.select("pvalue").where("pvalue is not null").distinct().collect()]
    reported = np.sort(np.array(distinct, float))
    medians = _simulated(rows.sparkSession, reported, n_trials - 1, parameters(avg_correlation), n_simulations, seed)
    joined = ready.join(medians, ready["pvalue"] == medians["_p"], "left").drop("_p")
    values = joined.withColumn("pvalue_bonferroni", F.when(F.col("pvalue").isNotNull(), F.least(F.lit(1.0), F.lit(n_trials - 1) * F.col("pvalue"))))
    values = values.withColumn("pvalue_average", (F.col("pvalue_bonferroni") + F.col("pvalue_holm") + F.col("pvalue_bhy")) / 3)
    out = [key, "sharpe", "n_obs", F.col("_a").alias("sharpe_annualized"), "pvalue"]
    for name in (*METHODS, "average"):
        p = F.col(f"pvalue_{name}")
        survived = _t(normal.t_isf, p / 2, F.col("_m") - 1) / F.sqrt("_m") * F.lit(math.sqrt(12))
        values = values.withColumn(f"sharpe_{name}", survived)
        out += [f"pvalue_{name}", f"sharpe_{name}", (1 - F.col(f"sharpe_{name}") / F.col("_a")).alias(f"haircut_{name}")]
    return values.select(*out)


def _simulated(spark: SparkSession, reported: np.ndarray, others: int, level: tuple[float, float, float], n_simulations: int, seed: int) -> DataFrame:
    """(_p, pvalue_holm, pvalue_bhy): medians over repetitions."""

    def repetitions(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                holm, bhy = adjusted_among(reported, other_trials(others, *level, np.random.default_rng([seed, int(i)])))
                yield pd.DataFrame({"_p": reported, "holm": holm, "bhy": bhy})

    parts = max(1, min(n_simulations, spark.sparkContext.defaultParallelism * 2))
    drawn = spark.range(n_simulations, numPartitions=parts).mapInPandas(repetitions, "_p double, holm double, bhy double")
    return drawn.groupBy("_p").agg(F.median("holm").alias("pvalue_holm"), F.median("bhy").alias("pvalue_bhy"))
