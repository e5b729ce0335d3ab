"""Queries over families of variants: search-adjusted p-values, bootstraps, the funnel and spanning regressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import normal
from panelyard.operators import panel as pn
from panelyard.operators import calibration, scan, search, sharpe, spanning, synth
from panelyard.plans import funnel
from panelyard.session import rounded, table


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, candidate, family, pos, ret): each supplier's monthly price change as a variant of its nation's family."""
    rows = pn.with_returns(pn.dense(pn.monthly_bars(table(spark, sf_dir, "lineitem"))))
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("family"))
    return rows.join(nation, "asset").select("date", F.col("asset").alias("candidate"), "family", F.col("asset").alias("pos"), "ret")


def register(add: Callable, grid: str) -> None:
    base = f"WITH {grid}, r AS (SELECT p.date, p.asset AS candidate, s.s_nationkey AS family, p.ret FROM panel p JOIN supplier s ON p.asset = s.s_suppkey)"
    tests = f"""{base}, t AS (SELECT candidate, any_value(family) AS family, count(ret) AS n, avg(ret) / stddev_pop(ret) AS sr, avg(ret) / stddev_samp(ret) AS ratio FROM r WHERE ret IS NOT NULL GROUP BY 1),
      z AS (SELECT *, sr * sqrt(n - 1) / sqrt(1 + sr * sr / 2) AS z FROM t), p AS (SELECT *, {normal.sf_sql("z")} AS p FROM z)"""

    def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = families(spark, sf_dir)
        out = sharpe.sharpe_test(rows.select("candidate", "date", "ret"), method="normal", periods=12)
        return out.join(rows.select("candidate", "family", "pos").distinct(), "candidate")

    @add(tests + " SELECT family, count(*) AS k, round(CASE WHEN min(p) >= 1 THEN 1 ELSE 1 - pow(1 - min(p), count(*)) END, 6) + 0.0 AS adjusted FROM p GROUP BY 1")
    def search_sidak(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = tested(spark, sf_dir).groupBy("family").agg(F.count("*").alias("k"), F.min("pvalue_greater").alias("p"))
        return best.select("family", "k", rounded(search.search_adjusted("p", "k")).alias("adjusted"))

    @add(tests + " SELECT family, candidate AS best FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ratio DESC, candidate) AS k FROM p) WHERE k = 1")
    def search_best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = families(spark, sf_dir)
        ratios = rows.where("ret is not null").groupBy("candidate").agg(F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("value"))
        return funnel.best_by_family(ratios.join(rows.select("candidate", "family", "pos").distinct(), "candidate")).select("family", "best")

    @add()
    def search_family_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.bootstrap_family_pvalues(families(spark, sf_dir), n_boot=999, min_blocks=5).select("family", rounded("pvalue").alias("pvalue"), "k", "best", rounded("t").alias("t"))

    @add()
    def funnel_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats, n = funnel.family_statistics(scan.kept(families(spark, sf_dir)), search_end="1999-12-31", holdout_start="2000-01-01", periods=12)
        out = funnel.run_funnel(stats, funnel.Thresholds(), n, periods=12)
        return out.select("family", "k", "best", *[rounded(c).alias(c) for c in ("rho", "p1_independent", "p1_rho", "p2")], "naive_pass", "stage1", "stage2", "stage3", "stage4")

    @add()
    def funnel_split_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats, n = funnel.split_statistics(scan.kept(families(spark, sf_dir)), search_end="1999-12-31", stage2_start="1998-01-01", holdout_start="2000-01-01", periods=12)
        out = funnel.run_funnel(stats, funnel.Thresholds(alpha2=0.5), n, periods=12)
        return out.select("family", "k", "best", *[rounded(c).alias(c) for c in ("p1_independent", "p1_rho", "p2")], "naive_pass", "stage1", "stage2", "stage4")

    @add()
    def funnel_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The flow of the nations' families through the stages, every fifth of them planted with a Sharpe ratio of 2."""
        rows = scan.kept(families(spark, sf_dir))
        real = rows.where("family % 5 = 0").select("candidate").distinct()
        returns = scan.kept(calibration.plant(rows, real, 2.0, periods=12).select(*rows.columns))
        stats, n = funnel.family_statistics(returns, search_end="1999-12-31", holdout_start="2000-01-01", periods=12)
        truth = rows.select("family", (F.col("family") % 5 == 0).alias("truth")).distinct()
        return funnel.gate_report(funnel.run_funnel(stats, funnel.Thresholds(), n, periods=12), truth)

    @add()
    def spanning_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = families(spark, sf_dir)
        wide = rows.where("ret is not null").groupBy("date").pivot("family", list(range(6))).agg(F.avg("ret"))
        names = ("f0", "f1", "f2", "f3", "f4", "f5")
        factors = wide.select("date", F.lit(0.0).alias("RF"), *[F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(n) for i, n in enumerate(names)])
        out = spanning.factor_alpha(rows.where("family > 5"), factors, returns_are_excess=True, names=names)
        return out.select("candidate", "n_obs", "lags", *[rounded(c, 5).alias(c) for c in ("alpha", "se", "t", "pvalue")])

    @add()
    def synthetic_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A panel of known truth as long and wide as the suppliers' own: their months, their number, a candidate for each nation."""
        months, assets, nations = _shape(spark, sf_dir)
        return synth.make_panel(spark, n_dates=months, n_assets=assets, n_candidates=nations, n_real=max(1, nations // 5), effect=0.3)[0]

    @add()
    def synthetic_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Returns of known truth for as many candidates and months as there are suppliers and months."""
        months, assets, _ = _shape(spark, sf_dir)
        return synth.make_return_matrix(spark, n_obs=months, n_candidates=assets, rho=0.3, ar1=0.1, t_df=5, garch=(0.05, 0.9))[0]


def _shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """Months of the lines, suppliers, and nations that have any."""
    months = table(spark, sf_dir, "lineitem").agg(F.countDistinct(F.date_trunc("month", "l_shipdate"))).first()[0]
    supplier = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"), F.countDistinct("s_nationkey").alias("m")).first()
    return max(3, months), max(1, supplier["n"]), max(1, supplier["m"])
