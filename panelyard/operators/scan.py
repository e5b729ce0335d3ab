"""Ranks and running extrema over a whole table in order, without a task that sees the whole table.

Rows are sorted by ranges of the order. A row's place is its range's first place plus its own within the range, and a
running extremum is that of the ranges before it combined with that within its range: one row a range and group travels
between ranges. Ties are broken by a hash of the row, so that a value that many rows share spreads over ranges.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or that the context has.

    A local master without that setting gets a temporary folder; a cluster without it is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="panelyard-")
    return _LOCAL[sc.applicationId]


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, so that a lost executor costs a read."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    joined = F.lit(True)
    for a, b in zip(left, right, strict=True):
        joined = joined & F.col(a).eqNullSafe(F.col(b))
    return joined


def _joined(rows: DataFrame, more: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of ``more``, which has a row for each value of ``by``, or one row in all."""
    if not by:
        return rows.crossJoin(F.broadcast(more))
    names = [f"_by{i}" for i in range(len(by))]
    return rows.join(more.withColumnsRenamed(dict(zip(by, names, strict=True))), _same(by, names), "left").drop(*names)


def sized(rows: DataFrame, by: Sequence[str] = (), **counts: Column) -> DataFrame:
    """``rows`` with aggregates of their group; without groups, of the whole table, sent as one row."""
    return _joined(rows, rows.groupBy(*by).agg(*[c.alias(name) for name, c in counts.items()]), by)


def ranked(rows: DataFrame, *order: Column, by: Sequence[str] = (), name: str = "_r", **counts: Column) -> DataFrame:
    """``rows`` with their rank from 1 within each group of ``by``, aggregates of the group, and ``_part`` and ``_id``.

    ``_id`` grows with (by, order) and ``_part`` is the range that a row lies in; :func:`running` reads both.
    """
    whole = [*[F.col(b).asc_nulls_first() for b in by], *order, F.xxhash64(*rows.columns)]
    placed = kept(rows.repartitionByRange(*whole).sortWithinPartitions(*whole).withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = parts.select(F.col("_part").alias("_from"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    at = placed.join(F.broadcast(starts), F.col("_part") == F.col("_from")).withColumn("_at", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_from", "_start")
    out = sized(at, by, _first=F.min("_at"), **counts)
    return out.withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


def running(rows: DataFrame, value: Column, name: str, *, by: Sequence[str] = (), largest: bool = True, from_end: bool = False) -> DataFrame:
    """``rows`` of :func:`ranked` with the largest (or least) value up to each row in order, or from the end down to it."""
    best = F.max if largest else F.min
    order = F.col("_id").desc() if from_end else F.col("_id")
    inside = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    valued = rows.withColumn("_v", value)
    part = F.col("_part").desc() if from_end else F.col("_part")
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = valued.groupBy("_part", *by).agg(best("_v").alias("_b")).withColumn("_c", best("_b").over(before)).drop("_b")
    pick = F.greatest if largest else F.least
    return _joined(valued.withColumn("_w", best("_v").over(inside)), carried, ["_part", *by]).withColumn(name, pick("_w", "_c")).drop("_v", "_w", "_c")
