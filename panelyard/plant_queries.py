"""Queries that plant effects into the suppliers' monthly price changes, nations being the families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import normal
from panelyard.operators import planting
from panelyard.plans import funnel
from panelyard.search_queries import families
from panelyard.session import rounded

GRID = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)
END, HELD, PERIODS = "1996-12-31", "1997-01-01", 12
THRESHOLDS = funnel.Thresholds(q1=0.2, stage1="independent", alpha2=0.1, q4=0.3)


def side(spark: SparkSession, sf_dir: str) -> planting.Side:
    return planting.null_side(families(spark, sf_dir), search_end=END, holdout_start=HELD, stage1="independent", method="normal", periods=PERIODS)


def register(add: Callable, grid: str) -> None:
    stats = f"""WITH {grid}, r AS (SELECT p.date, p.asset AS candidate, s.s_nationkey AS family, p.ret FROM panel p JOIN supplier s ON p.asset = s.s_suppkey),
  k AS (SELECT family, count(DISTINCT candidate) AS k FROM r GROUP BY 1),
  s AS (SELECT candidate, any_value(family) AS family, date > DATE '{END}' AS held, count(ret) AS n, avg(ret) AS mean, stddev_pop(ret) AS sd FROM r WHERE ret IS NOT NULL GROUP BY 1, 3),
  g AS (SELECT unnest([{", ".join(map(str, GRID))}]) AS sharpe),
  t AS (SELECT s.*, g.sharpe, (s.mean + g.sharpe * coalesce(v.sd, 0) / sqrt({PERIODS})) / s.sd AS sr FROM g, s LEFT JOIN (SELECT candidate, sd FROM s WHERE NOT held) v ON s.candidate = v.candidate WHERE s.sd > 0 AND s.n >= 2),
  z AS (SELECT *, sr / sqrt((1 + sr * sr / 2) / (n - 1)) AS z FROM t), p AS (SELECT *, {normal.sf_sql("z")} AS p FROM z),
  best AS (SELECT family, sharpe, candidate, p AS p2, min(p) OVER (PARTITION BY family, sharpe) AS least, row_number() OVER (PARTITION BY family, sharpe ORDER BY sr * sqrt((n - 1.0) / n) DESC, candidate) AS o FROM p WHERE NOT held),
  f AS (SELECT b.family, b.sharpe, b.candidate AS best, b.p2, CASE WHEN least >= 1 THEN 1 ELSE 1 - pow(1 - least, k.k) END AS p1, h.p AS ho_p
        FROM best b JOIN k USING (family) LEFT JOIN p h ON h.held AND h.candidate = b.candidate AND h.sharpe = b.sharpe WHERE o = 1)"""

    @add(
        stats
        + f""", w AS (SELECT t.family AS target, t.sharpe, o.family = t.family AS own, CASE WHEN o.family = t.family THEN t.p1 ELSE o.p1 END AS p1,
          CASE WHEN o.family = t.family THEN t.p2 ELSE o.p2 END AS p2, coalesce(CASE WHEN o.family = t.family THEN t.ho_p ELSE o.ho_p END, 1) AS q FROM f t, f o WHERE o.sharpe = 0),
  a AS (SELECT *, row_number() OVER (PARTITION BY target, sharpe ORDER BY p1) AS r, count(*) OVER (PARTITION BY target, sharpe) AS m FROM w),
  b AS (SELECT *, r <= coalesce(max(r) FILTER (p1 <= {THRESHOLDS.q1} * r / m) OVER (PARTITION BY target, sharpe), 0) AS stage1, p2 <= {THRESHOLDS.alpha2} AS stage2 FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY target, sharpe ORDER BY q) AS r4, count(*) OVER (PARTITION BY target, sharpe) AS m4 FROM b WHERE own OR (stage1 AND stage2)),
  d AS (SELECT *, r4 <= coalesce(max(r4) FILTER (q <= {THRESHOLDS.q4} * r4 / m4) OVER (PARTITION BY target, sharpe), 0) AS stage4 FROM c)
  SELECT target, sharpe, stage1, stage2, true AS stage3, stage4, stage1 AND stage2 AND stage4 AS accepted FROM d WHERE own"""
    )
    def planting_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Each family planted alone, with its variants' own spread, at every ratio: which stages it passes."""
        return planting.decisions(side(spark, sf_dir), THRESHOLDS, None, GRID, vol=None)

    @add(stats + " SELECT sharpe, family, best, round(p1, 6) + 0.0 AS p1, round(p2, 6) + 0.0 AS p2, round(ho_p, 6) + 0.0 AS ho_p FROM f WHERE family % 5 = 0 UNION ALL SELECT g.sharpe, family, best, round(p1, 6) + 0.0, round(p2, 6) + 0.0, round(ho_p, 6) + 0.0 FROM f, g WHERE f.sharpe = 0 AND family % 5 <> 0")
    def planting_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every fifth nation's family planted at once, beside the others as they are."""
        batch = side(spark, sf_dir)
        targets = [r["family"] for r in batch.families.where("family % 5 = 0").select("family").collect()]
        out = planting.planted_sides(batch, targets, GRID, vol=None)
        return out.select("sharpe", "family", "best", *[rounded(c).alias(c) for c in ("p1", "p2", "ho_p")])

    @add(
        f"""WITH {grid}, r AS (SELECT p.date, p.asset AS candidate, s.s_nationkey AS family, p.ret FROM panel p JOIN supplier s ON p.asset = s.s_suppkey WHERE p.ret IS NOT NULL),
  c AS (SELECT a.candidate AS x, b.candidate AS y, any_value(a.family) AS fa, any_value(b.family) AS fb, corr(a.ret, b.ret) AS c FROM r a JOIN r b ON a.date = b.date AND a.candidate < b.candidate GROUP BY 1, 2),
  i AS (SELECT fa, avg(c) AS c FROM c WHERE fa = fb AND NOT isnan(c) GROUP BY 1)
  SELECT round((SELECT avg(c) FROM i), 6) + 0.0 AS within, round((SELECT avg(c) FROM c WHERE fa <> fb AND NOT isnan(c)), 6) + 0.0 AS across"""
    )
    def planting_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Mean correlations inside nations' families and across them."""
        found = planting.correlations(families(spark, sf_dir))
        return found.select(rounded("within").alias("within"), rounded("across").alias("across"))

    @add(
        stats.replace("f AS (", "f0 AS (")
        + f""", f AS (SELECT * FROM f0), h AS (SELECT sharpe, avg(CASE WHEN p2 <= {THRESHOLDS.alpha2} THEN 1.0 ELSE 0.0 END) AS share FROM f GROUP BY 1),
  m AS (SELECT sharpe, max(share) OVER (ORDER BY sharpe) AS y FROM h), l AS (SELECT *, lag(sharpe) OVER (ORDER BY sharpe) AS x0, lag(y) OVER (ORDER BY sharpe) AS y0 FROM m)
  SELECT round(arg_min(CASE WHEN x0 IS NULL THEN sharpe ELSE x0 + (0.5 - y0) * (sharpe - x0) / (y - y0) END, sharpe), 6) + 0.0 AS at FROM l WHERE y >= 0.5"""
    )
    def planting_detectable(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The least ratio at which half the families pass stage 2 when planted."""
        found = planting.detectable(planting.decisions(side(spark, sf_dir), THRESHOLDS, None, GRID, vol=None), 0.5)
        return found.where("stage = 'stage2'").select(rounded("at").alias("at"))
