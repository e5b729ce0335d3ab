"""Queries on factors as texts: originality of formulas that rows of ``part`` write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators import originality
from panelyard.session import rounded, table

#: A formula for each remainder of a part's key by their number, with the part's size as its window.
FORMS = (
    "-1 * ts_rank(rank(low), %d)", "ts_mean(close, %d) / open", "rank(ts_std(close, %d)) + volume",
    "rank(ts_corr(open, volume, %d))", "close - (%d", "sign(delta(volume, %d) * 2) - high",
)


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, expression): a formula of each part."""
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.pmod("p_partkey", F.lit(len(FORMS))) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.replace(form, F.lit("%d"), F.col("p_size").cast("string")).alias("expression"))


def register(add: Callable) -> None:
    # The largest shared subtree of each form, counted by hand: alpha_004 whole; a field; rank and ts_std of close; ts_corr of open and volume; nothing, as it doesn't parse; sign of delta of volume.
    @add(
        """WITH f AS (SELECT p_partkey AS pos, p_partkey % 6 AS form, p_size AS w, first_value(p_size) OVER (PARTITION BY p_partkey % 6 ORDER BY p_partkey) AS w0, row_number() OVER (PARTITION BY p_partkey % 6 ORDER BY p_partkey) AS r FROM part),
  z(form, zoo_nodes, nodes, nearest_zoo) AS (VALUES (0, 6, 6, 'alpha_004'), (1, 1, 4, 'alpha_002'), (2, 3, 5, 'alpha_022'), (3, 3, 4, 'alpha_006'), (4, NULL, NULL, ''), (5, 5, 7, 'alpha_012'))
  SELECT pos, nodes, zoo_nodes, round(zoo_nodes / nodes, 6) + 0.0 AS zoo_share, nearest_zoo,
         CASE WHEN form = 4 THEN 'unparsable' WHEN form IN (0, 3) THEN 'rejected' WHEN r = 1 THEN 'stored' WHEN w = w0 THEN 'duplicate' ELSE 'rejected' END AS status FROM f JOIN z USING (form)"""
    )
    def originality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Each part's formula against the published ones and against those of the parts before it."""
        judged = originality.judge(formulas(spark, sf_dir), originality.zoo_index(spark))
        return judged.select("pos", "nodes", "zoo_nodes", rounded("zoo_share").alias("zoo_share"), "nearest_zoo", "status")

    @add(
        """WITH f AS (SELECT p_partkey % 6 AS form, p_partkey AS pos FROM part),
  s(form, shape, nodes) AS (VALUES (0, 'F:low', 1), (1, 'F:close', 1), (1, 'F:open', 1), (2, 'F:close', 1), (2, 'F:volume', 1), (3, 'F:open', 1), (3, 'F:volume', 1), (5, 'F:high', 1), (5, 'F:volume', 1),
    (0, '(rank F:low)', 2), (1, '(ts_mean F:close)', 2), (2, '(ts_std F:close)', 2), (3, '(ts_corr F:open F:volume)', 3), (5, '(delta F:volume)', 4), (5, '(sign (delta F:volume))', 5), (2, '(rank (ts_std F:close))', 3))
  SELECT shape, min(pos) AS first, count(*) AS owners, max(nodes) AS nodes FROM f JOIN s USING (form) GROUP BY 1"""
    )
    def originality_index(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The shapes of one to three levels that start at a field: their first owner, how many have them, and their largest size."""
        read = originality.parsed(formulas(spark, sf_dir)).withColumn("owner", F.col("pos").cast("string"))
        rows = read.select("pos", F.explode("shapes").alias("s")).select("pos", "s.shape", "s.nodes")
        kinds = ("F:low", "F:close", "F:open", "F:volume", "F:high", "(rank F:low)", "(ts_mean F:close)", "(ts_std F:close)", "(ts_corr F:open F:volume)", "(delta F:volume)", "(sign (delta F:volume))", "(rank (ts_std F:close))")
        firsts = originality.earliest(originality.subtree_index(read)).select("shape", F.col("first.pos").alias("first"))
        return rows.where(F.col("shape").isin(*kinds)).groupBy("shape").agg(F.count("*").alias("owners"), F.max("nodes").alias("nodes")).join(firsts, "shape").select("shape", "first", "owners", "nodes")
