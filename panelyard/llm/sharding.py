"""Shards by jump consistent hashing: no ring table, and appended shards take only their own share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm import scratch

#: The multiplier of the 64-bit linear congruential step that the published jump hash uses.
JUMP_STEP = 2862933555777941757


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard, 0 to ``n_shards`` - 1, of every unsigned 64-bit key.

    All keys step together: each pass advances those whose next jump still lands inside, which takes
    about ln(n_shards) passes.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    state = keys.astype(np.uint64)
    landed = np.zeros(len(state), np.int64)
    active = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(active):
            key = state[active] * np.uint64(JUMP_STEP) + np.uint64(1)
            state[active] = key
            step = float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0)
            target = np.floor((landed[active] + 1.0) * step)
            inside = target < n_shards
            active = active[inside]
            landed[active] = target[inside].astype(np.int64)
    return landed


def jump_shard(key: Column, n_shards: int) -> Column:
    """The jump shard of a bigint hash column."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), n_shards).astype(np.int32))

    return shard(key)


def assign_shards(docs: DataFrame, n_shards: int = 16, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every input row: key, size, text_crc32, shard, slot and grown_shard.

    ``shard`` depends on the key's hash and ``n_shards`` alone; ``grown_shard`` is the shard under one
    more shard, and differs from ``shard`` only where the row moves into the added one. ``slot`` counts
    from 0 without gaps within a shard.

    Slots are dealt in two levels, so that no shard's rows ever meet in one task: rows are ranked within
    (shard, input partition), and the partitions' counts give each its first slot. Only the narrow
    columns are shuffled; the text is read once and stays where it is. Slots follow the input's partitions, so
    the same rows dealt over other files get the same shards but other slots.

    Null text counts as empty (size 1, CRC of no bytes). A null key is a key like any other: all such
    rows share a shard, and are still ranked partition by partition. Repeated rows keep one slot each.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(key)).alias("_hash"),
        F.spark_partition_id().alias("_part"),
    )
    rows = scratch.written(
        hashed.select(
            F.col(key), "size", "text_crc32", "_part",
            jump_shard(F.col("_hash"), n_shards).alias("shard"),
            jump_shard(F.col("_hash"), n_shards + 1).alias("grown_shard"),
        ),
        "shards",
    )
    within = Window.partitionBy("shard", "_part").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (
        rows.withColumn("_rank", F.row_number().over(within) - 1)
        .join(starts, ["shard", "_part"])
        .select(F.col(key), "size", "text_crc32", "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, *, key: str = "doc_id") -> None:
    """Write ``docs`` under ``path``, one folder ``shard=i`` for each shard; all columns are kept but one named shard.

    Rows go straight from their input partition to the shard's folder, without a shuffle. Null and empty texts are
    written as they are, a null key goes where the hash of null leads, and repeated rows are all written. An empty
    table writes no rows. What stands under ``path`` is replaced.
    """
    placed = docs.withColumn("shard", jump_shard(F.xxhash64(F.col(key)), n_shards))
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
