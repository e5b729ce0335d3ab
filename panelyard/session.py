"""Session defaults and small helpers that every module shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "panelyard", master: str | None = None) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI mode, adaptive execution with skew handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_nan(c: Column | str) -> Column:
    """NaN as null: inside the engine a missing number is always null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), None).otherwise(c)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)
