"""Digests of tables that don't depend on how their rows lie in files, and what differs between two of them.

A row is a JSON array of its cells as texts, its hash the SHA-256 of that. Rows are dealt to parts by their hash, and a part's leaf
holds their number and the sums of the hash's four quarters modulo 2^64: sums don't mind the order, are made by partial aggregation, and
count repeated rows. The root is the digest of all leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARTERS = 4


def row_text(columns: Sequence[str]) -> Column:
    """Cells as texts in a JSON array, missing ones as null; a number is written as Spark casts it."""
    return F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))


def leaves(df: DataFrame, columns: Sequence[str] | None = None, *, parts: int = 64) -> DataFrame:
    """(part, n, s0, s1, s2, s3): a row for each part that has rows; columns in order of name unless given."""
    hashed = df.select(F.sha2(row_text(sorted(df.columns) if columns is None else columns).cast("binary"), 256).alias("h"))
    part = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"), F.lit(parts))
    quarter = lambda i: F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = hashed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), *[F.sum(quarter(i)).alias(f"s{i}") for i in range(QUARTERS)])
    return sums.select("part", "n", *[F.pmod(f"s{i}", F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)").alias(f"s{i}") for i in range(QUARTERS)])


def identity(df: DataFrame, columns: Sequence[str] | None = None, *, parts: int = 64) -> str:
    """The table's digest: the same however its rows are ordered, split or stored, another after any change of a cell."""
    names = sorted(df.columns) if columns is None else list(columns)
    rows = leaves(df, names, parts=parts).orderBy("part").collect()
    lines = [",".join(names), *("|".join(str(v) for v in r) for r in rows)]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def differing_parts(one: DataFrame, two: DataFrame, columns: Sequence[str] | None = None, *, parts: int = 64) -> DataFrame:
    """(part, ours, theirs): the parts whose leaves differ, with their numbers of rows."""
    side = lambda df, s: leaves(df, columns, parts=parts).select("part", F.col("n").alias(s), F.struct(*[f"s{i}" for i in range(QUARTERS)]).alias(f"_{s}"))
    met = side(one, "ours").join(side(two, "theirs"), "part", "full_outer")
    return met.where(~F.col("_ours").eqNullSafe(F.col("_theirs"))).select("part", F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("theirs", F.lit(0)).alias("theirs"))


def differing_rows(one: DataFrame, two: DataFrame, columns: Sequence[str] | None = None, *, parts: int = 64) -> DataFrame:
    """(row, ours, theirs): rows that one table has more often, as texts; only rows of differing parts are compared."""
    names = sorted(one.columns) if columns is None else list(columns)
    wrong = differing_parts(one, two, names, parts=parts).select("part")

    def counted(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(row_text(names).alias("row"))
        part = F.pmod(F.conv(F.substring(F.sha2(F.col("row").cast("binary"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(parts))
        return rows.withColumn("part", part).join(F.broadcast(wrong), "part", "left_semi").groupBy("row").agg(F.count("*").alias(name))

    met = counted(one, "ours").join(counted(two, "theirs"), "row", "full_outer").na.fill(0, ["ours", "theirs"])
    return met.where("ours <> theirs")


def export(df: DataFrame, path: str, *, parts: int = 64) -> dict:
    """Write a table and, beside it, its release record: columns, rows and digest; the record comes last."""
    record = {"columns": sorted(df.columns), "rows": df.count(), "identity": identity(df, parts=parts), "parts": parts}
    df.write.mode("overwrite").parquet(f"{path}/table")
    rows = [(record["columns"], record["rows"], record["identity"], parts)]
    df.sparkSession.createDataFrame(rows, "columns array<string>, rows bigint, identity string, parts int").coalesce(1).write.mode("overwrite").json(f"{path}/release")
    return record


def verified(spark, path: str) -> DataFrame:
    """The exported table; raises if it isn't what its record says."""
    record = spark.read.schema("columns array<string>, rows bigint, identity string, parts int").json(f"{path}/release").first()
    if record is None:
        raise FileNotFoundError(f"{path} has no release record")
    df = spark.read.parquet(f"{path}/table")
    if sorted(df.columns) != sorted(record["columns"]) or identity(df, parts=record["parts"]) != record["identity"]:
        raise ValueError(f"{path}: the table isn't the one that was released")
    return df
