"""A data dictionary: columns with their meanings, the codes found in them, and facts that must hold of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def code_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, code, n) of coded columns, in one pass: rows are pre-aggregated by code, so only counts are shuffled."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("code")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).select("x.column", "x.code").where("code is not null").groupBy("column", "code").agg(F.count("*").alias("n"))


def code_values(counts: DataFrame, meanings: DataFrame) -> DataFrame:
    """(column, values): codes with their meaning, most frequent first, in one text; a code without a meaning ends the query."""
    known = counts.join(meanings, ["column", "code"], "left")
    told = F.when(F.col("meaning").isNull(), F.raise_error(F.concat(F.lit("no meaning for "), "column", F.lit("="), "code")).cast("string")).otherwise(F.concat("code", F.lit(": "), "meaning"))
    listed = known.withColumn("told", told).groupBy("column").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "code", "told"))).alias("x"))
    return listed.select("column", F.array_join(F.transform("x", lambda e: e["told"]), "; ").alias("values"))


def build(df: DataFrame, described: DataFrame, coded: Sequence[str], meanings: DataFrame) -> DataFrame:
    """(position, column, type, description, values) for every column; one without a description has null there."""
    spark = df.sparkSession
    catalogue = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "position int, column string, type string")
    values = code_values(code_counts(df, coded), meanings) if coded else spark.createDataFrame([], "column string, values string")
    return catalogue.join(described, "column", "left").join(values, "column", "left").select("position", "column", "type", "description", "values")


def claims(df: DataFrame, facts: dict[str, tuple[str, float, float]]) -> DataFrame:
    """(claim, share, holds): for each named SQL condition the share of rows that meet it, and whether it lies in its range; one pass."""
    shares = df.agg(*[F.avg(F.expr(f"case when {sql} then 1.0d else 0.0d end")).alias(name) for name, (sql, _, _) in facts.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("claim"), F.col(f"`{n}`").alias("share"), F.col(f"`{n}`").between(lo, hi).alias("holds")) for n, (_, lo, hi) in facts.items()])
    return shares.select(F.explode(rows).alias("x")).select("x.*")
