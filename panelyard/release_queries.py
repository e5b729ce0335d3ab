"""Queries on releases of tables: digests by parts, what differs, and reads of a pinned copy."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators import release, scan
from panelyard.session import rounded, table
from panelyard.sources import shared

COLUMNS, PARTS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), 32


def register(add: Callable) -> None:
    text = "to_json([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, {priority}])::VARCHAR"
    hashed = lambda priority: f"SELECT sha256({text.format(priority=priority)}) AS h FROM orders"
    quarter = lambda i: f"CAST(sum(CAST(('0x' || substr(h, {16 * i + 1}, 16))::UBIGINT AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS s{i}"
    part = f"('0x' || substr(h, 1, 8))::BIGINT % {PARTS} AS part"

    @add(f"SELECT {part}, count(*) AS n, {', '.join(quarter(i) for i in range(4))} FROM ({hashed('o_orderpriority')}) GROUP BY 1")
    def release_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The leaves of the orders' digest."""
        out = release.leaves(table(spark, sf_dir, "orders"), COLUMNS, parts=PARTS)
        return out.select("part", "n", *[F.col(f"s{i}").cast("string").alias(f"s{i}") for i in range(4)])

    changed = "CASE WHEN o_orderkey % 1000 = 7 THEN 'changed' ELSE o_orderpriority END"

    @add(f"""WITH a AS (SELECT part, count(*) AS n FROM (SELECT {part} FROM ({hashed("o_orderpriority")})) GROUP BY 1), b AS (SELECT part, count(*) AS n FROM (SELECT {part} FROM ({hashed(changed)})) GROUP BY 1),
  w AS (SELECT DISTINCT {part} FROM (SELECT sha256({text.format(priority="o_orderpriority")}) AS h FROM orders WHERE o_orderkey % 1000 = 7 UNION ALL SELECT sha256({text.format(priority="'changed'")}) FROM orders WHERE o_orderkey % 1000 = 7))
  SELECT w.part, coalesce(a.n, 0) AS ours, coalesce(b.n, 0) AS theirs FROM w LEFT JOIN a USING (part) LEFT JOIN b USING (part)""")
    def release_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The parts that name a copy of the orders in which one in a thousand has another priority."""
        orders = table(spark, sf_dir, "orders")
        other = orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 1000 == 7, "changed").otherwise(F.col("o_orderpriority")))
        return release.differing_parts(orders, other, COLUMNS, parts=PARTS)

    @add("SELECT n_name AS nation, count(*) AS suppliers, round(sum(s_acctbal), 2) + 0.0 AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
    def shared_pinned_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Suppliers by nation, from verified copies of both tables that are pinned to one version."""
        local = f"{scan.shared_folder(spark).removeprefix('file://')}/shared-{uuid.uuid4().hex}"
        manifest = f"{local}/published.sha256"
        version = shared.publish(spark, sf_dir, ["supplier.parquet", "nation.parquet"], manifest=manifest)
        shared.sync(spark, sf_dir, local, manifest=manifest)
        read = lambda name: shared.load(spark, local, name, version=version)
        met = read("supplier").join(F.broadcast(read("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        return met.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("suppliers"), rounded(F.sum("s_acctbal"), 2).alias("balance"))
