"""Registry of the panel queries and their DuckDB counterparts.

Each query runs over its whole tables. Doubles are rounded in both engines, since sums in another order differ in
their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import grammar, normal
from panelyard.operators import backtest as bt
from panelyard.operators import sharpe, validation
from panelyard.operators import multiple_testing as mt
from panelyard.operators import panel as pn
from panelyard.session import rounded, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str, digits: int = 6):
    return [rounded(n, digits).alias(n) for n in names]


def _rs(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


# ---- panels and backtests

BARS = """bars AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS asset,
         first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""
GRID = (
    BARS
    + """, grid AS (SELECT d.date, a.asset FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT asset FROM bars) a),
  panel AS (SELECT g.date, g.asset, b.open, b.high, b.low, b.close, b.volume,
                   b.close / nullif(lag(b.close) OVER (PARTITION BY g.asset ORDER BY g.date), 0) - 1 AS ret
            FROM grid g LEFT JOIN bars b ON g.date = b.date AND g.asset = b.asset)"""
)
SIGNALS = (
    GRID
    + """, factors AS (
  SELECT *, -ret AS reversal,
         lag(close, 1) OVER w / nullif(lag(close, 4) OVER w, 0) - 1 AS momentum,
         volume / nullif(CASE WHEN count(volume) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
                              THEN avg(volume) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 0) - 1 AS volume_gap,
         (high - low) / nullif(close, 0) AS spread
  FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date)),
  signals AS (
    SELECT 'momentum' AS candidate, date, asset, momentum AS signal, ret FROM factors
    UNION ALL SELECT 'reversal', date, asset, reversal, ret FROM factors
    UNION ALL SELECT 'spread', date, asset, spread, ret FROM factors
    UNION ALL SELECT 'volume_gap', date, asset, volume_gap, ret FROM factors)"""
)
FACTORS = {"reversal": "-returns", "momentum": "shift(close, 1) / shift(close, 4) - 1", "volume_gap": "volume / ts_mean(volume, 3) - 1", "spread": "(high - low) / close"}


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.with_returns(pn.dense(pn.monthly_bars(table(spark, sf_dir, "lineitem"))))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = grammar.with_factors(_panel(spark, sf_dir), FACTORS, renames={"returns": "ret"})
    rows = F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).alias("signal")) for c in sorted(FACTORS)])
    return wide.select("date", "asset", "ret", F.explode(rows).alias("s")).select("s.candidate", "date", "asset", "s.signal", "ret")


def _weights_sql(hold: int = 1) -> str:
    held = "w0" if hold == 1 else f"last_value(CASE WHEN turn % {hold} = 0 THEN w0 END IGNORE NULLS) OVER (PARTITION BY candidate, asset ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return (
        SIGNALS
        + f""", centred AS (SELECT *, coalesce(signal - avg(signal) OVER (PARTITION BY candidate, date), 0) AS v,
                dense_rank() OVER (PARTITION BY candidate, asset ORDER BY date) - 1 AS turn FROM signals),
  scaled AS (SELECT *, CASE WHEN sum(abs(v)) OVER (PARTITION BY candidate, date) > 0
                       THEN v / sum(abs(v)) OVER (PARTITION BY candidate, date) ELSE 0 END AS w0 FROM centred),
  book AS (SELECT *, {held} AS weight FROM scaled)"""
    )


def _net_sql(hold: int = 1, rate: str = "0.001", paid: str | None = None) -> str:
    silent = "max(CASE WHEN signal IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY candidate, date) = 0"
    if hold > 1:
        silent = f"(last_value(CASE WHEN turn % {hold} = 0 THEN (silent0)::INT END IGNORE NULLS) OVER (PARTITION BY candidate, asset ORDER BY date ROWS UNBOUNDED PRECEDING)) = 1"
    return (
        _weights_sql(hold)
        + f""", book0 AS (SELECT *, max(CASE WHEN signal IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY candidate, date) = 0 AS silent0, {rate} AS rate FROM book),
  book1 AS (SELECT *, {silent if hold > 1 else "silent0"} AS silent FROM book0),
  pos AS (SELECT *, lag(weight) OVER s AS p, lag(rate) OVER s AS paid, coalesce(lag(silent) OVER s, true) AS quiet FROM book1 WINDOW s AS (PARTITION BY candidate, asset ORDER BY date)),
  trades AS (SELECT *, abs(coalesce(p, 0) - coalesce(lag(p) OVER (PARTITION BY candidate, asset ORDER BY date), 0)) AS trade FROM pos),
  daily AS (SELECT candidate, date, coalesce(sum(p * ret), 0) AS gross0, sum(trade * coalesce(paid, 0)) AS cost0, sum(trade) AS turnover0, bool_and(quiet) AS idle FROM trades GROUP BY 1, 2),
  net AS (SELECT candidate, date, CASE WHEN NOT (idle AND turnover0 = 0) THEN gross0 - cost0 END AS net, CASE WHEN NOT (idle AND turnover0 = 0) THEN gross0 END AS gross,
                 CASE WHEN NOT (idle AND turnover0 = 0) THEN cost0 END AS cost, CASE WHEN NOT (idle AND turnover0 = 0) THEN turnover0 END AS turnover FROM daily)"""
    )


SUMMARY = """, wealth AS (SELECT *, exp(0) * product(1 + net) OVER (PARTITION BY candidate ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM net WHERE net IS NOT NULL),
  falls AS (SELECT *, w / nullif(greatest(1.0, max(w) OVER (PARTITION BY candidate ORDER BY date ROWS UNBOUNDED PRECEDING)), 0) - 1 AS fall FROM wealth),
  summary AS (SELECT candidate, count(net) AS n_obs, avg(net) * 12 AS ann_mean, stddev_samp(net) * sqrt(12) AS ann_vol,
                     avg(net) * 12 / (stddev_samp(net) * sqrt(12)) AS sharpe, min(fall) AS max_drawdown, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(turnover) AS turnover
              FROM falls GROUP BY 1)"""


@_register("WITH " + BARS + f" SELECT date, asset, {_rs('open', 'high', 'low', 'close', 'volume', digits=8)} FROM bars")
def panel_monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.monthly_bars(table(spark, sf_dir, "lineitem")).select("date", "asset", *_r("open", "high", "low", "close", "volume", digits=8))


@_register("WITH " + GRID + f" SELECT date, asset, {_rs('close', 'ret', digits=8)} FROM panel")
def panel_dense_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("date", "asset", *_r("close", "ret", digits=8))


@_register("WITH " + GRID + " SELECT date, CAST(asset AS VARCHAR) AS asset, round(abs(close), 8) + 0.0 AS price FROM grid LEFT JOIN bars USING (date, asset)")
def panel_price_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price panel of every asset in long form: a column for each asset would bound how many there can be."""
    bars = pn.monthly_bars(table(spark, sf_dir, "lineitem")).withColumn("seq", F.lit(0))
    return pn.price_cells(bars).select("date", F.col("asset").cast("string").alias("asset"), rounded("price", 8).alias("price"))


@_register("WITH " + _weights_sql() + " SELECT candidate, date, asset, round(weight, 8) + 0.0 AS weight FROM book")
def backtest_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.to_weights(_signals(spark, sf_dir)).select("candidate", "date", "asset", *_r("weight", digits=8))


def _net(frame: DataFrame) -> DataFrame:
    return frame.select("candidate", "date", *_r("net", "gross", "cost", "turnover"))


@_register("WITH " + _net_sql() + f" SELECT candidate, date, {_rs('net', 'gross', 'cost', 'turnover')} FROM net")
def backtest_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net(bt.backtest(_signals(spark, sf_dir), cost_bps=10.0))


@_register("WITH " + _net_sql(3) + f" SELECT candidate, date, {_rs('net', 'gross', 'cost', 'turnover')} FROM net")
def backtest_hold_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net(bt.backtest(_signals(spark, sf_dir), cost_bps=10.0, hold=3))


@_register("WITH " + _net_sql(1, "coalesce(CASE WHEN asset % 3 > 0 THEN (5.0 + asset % 7) END, median(CASE WHEN asset % 3 > 0 THEN (5.0 + asset % 7) END) OVER (PARTITION BY candidate, date)) / 10000.0") + f" SELECT candidate, date, {_rs('net', 'gross', 'cost', 'turnover')} FROM net")
def backtest_cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = _signals(spark, sf_dir).withColumn("cost_bps", F.when(F.col("asset") % 3 > 0, (5 + F.col("asset") % 7).cast("double")))
    return _net(bt.backtest(priced, cost_bps=None))


@_register()
def backtest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _net(bt.backtest(_signals(spark, sf_dir), cost_bps=10.0, band=0.002))


@_register("WITH " + _net_sql() + ", first AS (SELECT min(date) AS d FROM net) SELECT candidate, date, round(net, 6) + 0.0 AS ret FROM net, first WHERE date > d")
def backtest_candidate_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.candidate_returns(_signals(spark, sf_dir), cost_bps=10.0).select("candidate", "date", *_r("ret"))


@_register("WITH " + _net_sql() + SUMMARY + f" SELECT candidate, n_obs, {_rs('ann_mean', 'ann_vol', 'sharpe', 'max_drawdown', 'hit_rate', 'turnover', digits=5)} FROM summary WHERE n_obs >= 60")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bt.summarize(bt.backtest(_signals(spark, sf_dir), cost_bps=10.0), freq="monthly")
    return rows.where("n_obs >= 60").select("candidate", "n_obs", *_r("ann_mean", "ann_vol", "sharpe", "max_drawdown", "hit_rate", "turnover", digits=5))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidate signals survive a correction for how many were tried."""
    rows = bt.sweep(_signals(spark, sf_dir), cost_bps=10.0, freq="monthly")
    decided = mt.bonferroni(mt.benjamini_hochberg(rows, 0.05, p="pvalue", name="bh"), 0.05, p="pvalue", name="bonferroni")
    return decided.select("candidate", "n_obs", *_r("sharpe", "pvalue", digits=5), "bh", "bonferroni")


_FLAG_SQL = (
    "WITH "
    + _net_sql()
    + SUMMARY
    + f""", tested AS (SELECT *, {normal.sharpe_pvalue_sql("sharpe", "n_obs", 12)} AS p FROM summary),
  ranked AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(p) OVER () AS m, count(*) OVER () AS total FROM tested),
  cut AS (SELECT coalesce(max(r), 0) AS c FROM ranked WHERE p <= 0.05 * r / m)
  SELECT candidate, n_obs, round(sharpe, 5) + 0.0 AS sharpe, round(p, 5) + 0.0 AS pvalue, r <= c AS bh, p <= 0.05 / total AS bonferroni FROM ranked, cut"""
)
_register(_FLAG_SQL)(flagship)


# ---- corrections for many tests, over one p-value for each part: is its mean discount different from that of all?

PVALUES = f"""tests AS (SELECT l_partkey AS candidate, count(*) AS n, avg(l_discount) AS mean, stddev_samp(l_discount) AS sd FROM lineitem GROUP BY 1),
  overall AS (SELECT avg(l_discount) AS mu FROM lineitem),
  z AS (SELECT candidate, CASE WHEN n >= 3 AND sd > 0 THEN abs(mean - mu) / (sd / sqrt(n)) END AS z FROM tests, overall),
  pv AS (SELECT candidate, 2 * {normal.sf_sql("z")} AS p FROM z)"""


def _pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    tests = rows.groupBy(F.col("l_partkey").alias("candidate")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean"), F.stddev_samp("l_discount").alias("sd"))
    z = tests.crossJoin(F.broadcast(rows.agg(F.avg("l_discount").alias("mu")))).select("candidate", F.when((F.col("n") >= 3) & (F.col("sd") > 0), F.abs(F.col("mean") - F.col("mu")) / (F.col("sd") / F.sqrt("n"))).alias("z"))
    return z.select("candidate", (2 * F.expr(normal.sf_sql("z"))).alias("p"))


_RANKED = ", o AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST) AS r, count(p) OVER () AS m, count(*) OVER () AS total FROM pv)"


@_register("WITH " + PVALUES + " SELECT candidate, coalesce(p <= 0.2 / count(*) OVER (), false) AS rejected FROM pv")
def correct_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.bonferroni(_pvalues(spark, sf_dir), 0.2).select("candidate", "rejected")


@_register("WITH " + PVALUES + _RANKED + ", f AS (SELECT coalesce(min(r), 1000000000) AS f FROM o WHERE p IS NULL OR p > 0.2 / (total - r + 1)) SELECT candidate, r < f AS rejected FROM o, f")
def correct_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.holm(_pvalues(spark, sf_dir), 0.2).select("candidate", "rejected")


@_register("WITH " + PVALUES + _RANKED + ", c AS (SELECT coalesce(max(r), 0) AS c FROM o WHERE p <= 0.2 * r / m) SELECT candidate, p IS NOT NULL AND r <= c AS rejected FROM o, c")
def correct_benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.benjamini_hochberg(_pvalues(spark, sf_dir), 0.2).select("candidate", "rejected")


@_register("WITH " + PVALUES + _RANKED + ", h AS (SELECT sum(1.0 / i) AS h FROM range(1, (SELECT max(total) + 1 FROM o)) t(i)), c AS (SELECT coalesce(max(r), 0) AS c FROM o, h WHERE p <= 0.2 * r / (total * h)) SELECT candidate, p IS NOT NULL AND r <= c AS rejected FROM o, c")
def correct_benjamini_yekutieli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.benjamini_yekutieli(_pvalues(spark, sf_dir), 0.2).select("candidate", "rejected")


@_register(
    "WITH "
    + PVALUES
    + _RANKED
    + """, h AS (SELECT sum(1.0 / i) AS h FROM range(1, (SELECT max(total) + 1 FROM o)) t(i)),
  pi AS (SELECT least(1.0, count(*) FILTER (p > 0.5) / (0.5 * count(p))) AS pi0 FROM pv),
  x AS (SELECT *, count(p) OVER (ORDER BY p NULLS LAST RANGE UNBOUNDED PRECEDING) AS upto FROM o, h, pi)
  SELECT candidate, round(p, 6) + 0.0 AS p,
    CASE WHEN p IS NOT NULL THEN round(least(1.0, max(p * (total - r + 1)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)), 6) + 0.0 END AS holm,
    CASE WHEN p IS NOT NULL THEN round(least(1.0, min(p * total * h / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 END AS "by",
    CASE WHEN p IS NOT NULL THEN round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 END AS bh,
    CASE WHEN p IS NOT NULL THEN round(least(1.0, min(pi0 * m * p / upto) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 END AS q
  FROM x"""
)
def correct_evidence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.evidence_profile(_pvalues(spark, sf_dir)).select("candidate", *_r("p", "holm", "by", "bh", "q"))


@_register("WITH " + PVALUES + " SELECT round(least(1.0, count(*) FILTER (p > 0.5) / (0.5 * count(p))), 6) + 0.0 AS pi0, count(p) AS m FROM pv WHERE p IS NOT NULL")
def correct_pi0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.estimate_pi0(_pvalues(spark, sf_dir)).select(*_r("pi0"), "m")


@_register(
    "WITH "
    + PVALUES
    + """, g AS (SELECT i / 20.0::DOUBLE AS lam FROM range(20) t(i)), c AS (SELECT lam, count(p) AS m, count(*) FILTER (p <= 0.05) AS r, CASE WHEN lam = 0 THEN 1 ELSE count(*) FILTER (p > round(lam, 2)) / ((1 - lam) * count(p)) END AS s FROM g, pv GROUP BY 1)
  SELECT round(lam, 2) AS lam, round(least(1.0, s), 6) + 0.0 AS pi0, round(least(1.0, s * 0.05 / (greatest(r, 1) / m * (1 - pow(0.95, m)))), 6) + 0.0 AS pfdr FROM c"""
)
def correct_pfdr_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.pfdr_grid(_pvalues(spark, sf_dir)).select("lam", *_r("pi0", "pfdr"))


@_register()
def correct_bootstrap_pi0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of true nulls at the bootstrap's lambda, and Storey's values with it."""
    rows = _pvalues(spark, sf_dir)
    lam = mt.bootstrap_lambda(rows)
    return mt.storey_qvalues(rows, lam).crossJoin(F.broadcast(mt.estimate_pi0(rows, lam))).select("candidate", F.lit(lam).alias("lam"), "m", *_r("pi0", "p", "q"))


_DECIDED = "WITH " + PVALUES + ", d AS (SELECT coalesce(p <= 0.05, false) AS rejected, candidate % 10 = 0 AS truth FROM pv)"


@_register(
    _DECIDED
    + """, s AS (SELECT count(*) FILTER (rejected) AS discoveries, count(*) FILTER (rejected AND truth) AS true_discoveries, count(*) FILTER (rejected AND NOT truth) AS false_discoveries, count(*) FILTER (truth) AS n_true FROM d)
  SELECT discoveries, true_discoveries, false_discoveries, n_true, round(false_discoveries / greatest(discoveries, 1), 6) + 0.0 AS fdr,
         round(true_discoveries / nullif(n_true, 0), 6) + 0.0 AS power, round(true_discoveries / nullif(discoveries, 0), 6) + 0.0 AS precision FROM s"""
)
def correct_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _pvalues(spark, sf_dir).select(F.coalesce(F.col("p") <= 0.05, F.lit(False)).alias("rejected"), (F.col("candidate") % 10 == 0).alias("truth"))
    return mt.score(decided).select("discoveries", "true_discoveries", "false_discoveries", "n_true", *_r("fdr", "power", "precision"))


# ---- Sharpe-ratio inference, on the candidates' returns

_RET = "WITH " + _net_sql() + ", r0 AS (SELECT candidate, date, net AS ret FROM net WHERE net IS NOT NULL), mom AS (SELECT candidate, count(ret) AS n_obs, avg(ret) AS mean FROM r0 GROUP BY 1), dev AS (SELECT r0.candidate, date, ret, n_obs, mean, ret - mean AS d FROM r0 JOIN mom USING (candidate)), mm AS (SELECT candidate, any_value(n_obs) AS n_obs, any_value(mean) AS mean, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM dev GROUP BY 1)"
_HAC = (
    _RET
    + """, g AS (SELECT dev.candidate, date, dev.n_obs, floor(4.0 * pow(dev.n_obs / 100.0, 2.0 / 9.0)) AS lags, d / sqrt(m2) - dev.mean / (2 * pow(m2, 1.5)) * (d * d - m2) AS g, row_number() OVER (PARTITION BY dev.candidate ORDER BY date) AS i FROM dev JOIN mm USING (candidate)),
  pairs AS (SELECT a.candidate, CASE WHEN a.i = b.i THEN 1.0 ELSE 2 * (1 - (a.i - b.i) / (a.lags + 1.0)) END * a.g * b.g / a.n_obs AS v FROM g a JOIN g b ON a.candidate = b.candidate AND a.i >= b.i AND a.i - b.i <= a.lags),
  var AS (SELECT candidate, sum(v) AS variance FROM pairs GROUP BY 1),
  tested AS (SELECT mm.candidate, n_obs, variance, mean / sqrt(m2) * sqrt(12) AS sharpe, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurtosis, sqrt(variance / (n_obs - 1) * 12) AS se FROM mm JOIN var USING (candidate)),
  z AS (SELECT *, sharpe / se AS z, abs(sharpe / se) AS az FROM tested)"""
)


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.backtest(_signals(spark, sf_dir), cost_bps=10.0).select("candidate", "date", F.col("net").alias("ret"))


@_register(_RET + f" SELECT candidate, n_obs, {_rs('mean', 'm2', 'm3', 'm4')} FROM mm")
def sharpe_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharpe.moments(_returns(spark, sf_dir)).select("candidate", "n_obs", *_r("mean", "m2", "m3", "m4"))


@_register(_RET + " SELECT candidate, round(1 - m3 / pow(m2, 1.5) * mean / sqrt(m2) + (m4 / (m2 * m2) - 1) / 4 * mean * mean / m2, 6) + 0.0 AS variance FROM mm")
def sharpe_variance_nonnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharpe.sharpe_variance(_returns(spark, sf_dir), method="nonnormal").select("candidate", *_r("variance"))


@_register(_HAC + f" SELECT candidate, n_obs, {_rs('sharpe', 'skew', 'kurtosis', 'variance', 'se')}, round(2 * {normal.sf_sql('az')}, 6) + 0.0 AS pvalue, round({normal.sf_sql('z')}, 6) + 0.0 AS pvalue_greater, round(1 - {normal.sf_sql('z')}, 6) + 0.0 AS psr FROM z")
def sharpe_test_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharpe.sharpe_test(_returns(spark, sf_dir), periods=12).select("candidate", "n_obs", *_r("sharpe", "skew", "kurtosis", "variance", "se", "pvalue", "pvalue_greater", "psr"))


_BEST = f"({normal.expected_max(4)!r} / sqrt(n_obs) * sqrt(12))"


@_register(_HAC + f", b AS (SELECT *, {_BEST} AS best FROM z) SELECT candidate, round({normal.psr_sql('sharpe', 'n_obs', 'best', 'variance', 12)}, 6) + 0.0 AS dsr, CASE WHEN sharpe <= 0 THEN NULL ELSE round(1 + variance * pow({normal.ppf(0.95)!r} / (sharpe / sqrt(12)), 2), 3) + 0.0 END AS min_trl FROM b")
def sharpe_deflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = sharpe.sharpe_test(_returns(spark, sf_dir), periods=12)
    out = sharpe.min_track_record(sharpe.deflated(tests, 4, periods=12), periods=12)
    return out.select("candidate", *_r("dsr"), F.when(F.col("min_trl") != float("inf"), rounded("min_trl", 3)).alias("min_trl"))


@_register(_RET + " , p AS (SELECT a.candidate AS a, b.candidate AS b, count(*) AS n, covar_pop(a.ret, b.ret) / nullif(sqrt(var_pop(a.ret) * var_pop(b.ret)), 0) AS r FROM r0 a JOIN r0 b ON a.date = b.date AND a.candidate < b.candidate GROUP BY 1, 2) SELECT a, b, n, round(r, 6) + 0.0 AS r FROM p")
def sharpe_pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharpe.pair_correlations(_returns(spark, sf_dir)).select("a", "b", "n", *_r("r"))


@_register(_RET + " , p AS (SELECT covar_pop(a.ret, b.ret) / nullif(sqrt(var_pop(a.ret) * var_pop(b.ret)), 0) AS r FROM r0 a JOIN r0 b ON a.date = b.date AND a.candidate < b.candidate GROUP BY a.candidate, b.candidate) SELECT round(avg(r), 6) + 0.0 AS avg_correlation FROM p")
def sharpe_average_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharpe.average_correlation(_returns(spark, sf_dir)).select(*_r("avg_correlation"))


# ---- the factor language, over the dense panel

_ROLL = "OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"


def _roll(f: str, x: str, d: int) -> str:
    w = _ROLL.format(k=d - 1)
    return f"CASE WHEN count({x}) {w} = {d} THEN {f} {w} END"


_FX_ROLL = {
    "ts_mean": ("ts_mean(close, 5)", _roll("avg(close)", "close", 5)),
    "ts_std": ("ts_std(close, 5)", _roll("stddev_samp(close)", "close", 5)),
    "ts_sum": ("ts_sum(volume, 4)", _roll("sum(volume)", "volume", 4)),
    "ts_min": ("ts_min(low, 6)", _roll("min(low)", "low", 6)),
    "ts_max": ("ts_max(high, 6)", _roll("max(high)", "high", 6)),
    "delta": ("delta(close, 2)", "close - lag(close, 2) OVER (PARTITION BY asset ORDER BY date)"),
    "shift": ("shift(close, 3)", "lag(close, 3) OVER (PARTITION BY asset ORDER BY date)"),
    "zscore": ("zscore(close, 5)", f"(close - ({_roll('avg(close)', 'close', 5)})) / nullif({_roll('stddev_samp(close)', 'close', 5)}, 0)"),
    "ts_product": ("ts_product(close / shift(close, 1), 3)", "CASE WHEN count(rel) OVER v = 3 THEN product(rel) OVER v END"),
    "ts_cov": ("ts_cov(close, volume, 5)", _roll("covar_samp(close, volume)", "close", 5)),
    "decay": ("decay_linear(close, 3)", "(close * 3 + lag(close, 1) OVER (PARTITION BY asset ORDER BY date) * 2 + lag(close, 2) OVER (PARTITION BY asset ORDER BY date)) / 6"),
    "logs": ("log(close) - sign(low) * abs(high)", "ln(CASE WHEN close > 0 THEN close END) - sign(low) * abs(high)"),
    "power": ("signed_power(delta(close, 1), 2)", "sign(close - lag(close) OVER (PARTITION BY asset ORDER BY date)) * pow(abs(close - lag(close) OVER (PARTITION BY asset ORDER BY date)), 2)"),
}


@_register(
    "WITH " + GRID + ", rels AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY date), 0) AS rel FROM panel), f AS (SELECT date, asset, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in _FX_ROLL.items())
    + " FROM rels WINDOW v AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT date, asset, " + _rs(*_FX_ROLL, digits=7) + " FROM f"
)
def factor_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = grammar.with_factors(_panel(spark, sf_dir), {n: e for n, (e, _) in _FX_ROLL.items()}, renames={"returns": "ret"})
    return wide.select("date", "asset", *_r(*_FX_ROLL, digits=7))


@_register(
    "WITH " + GRID + """, f AS (SELECT date, asset,
    CASE WHEN close IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY close NULLS LAST) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / nullif(count(close) OVER (PARTITION BY date), 0) END AS ranked,
    close / nullif(sum(abs(close)) OVER (PARTITION BY date), 0) AS scaled,
    CASE WHEN close IS NOT NULL THEN greatest(least(close, quantile_cont(close, 0.99) OVER (PARTITION BY date)), quantile_cont(close, 0.01) OVER (PARTITION BY date)) END AS clipped FROM panel)
  SELECT date, asset, """ + _rs("ranked", "scaled", "clipped", digits=8) + " FROM f"
)
def factor_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = grammar.with_factors(_panel(spark, sf_dir), {"ranked": "rank(close)", "scaled": "scale(close)", "clipped": "winsorize(close)"})
    return wide.select("date", "asset", *_r("ranked", "scaled", "clipped", digits=8))


@_register(
    "WITH " + GRID + """, l AS (SELECT date, asset, close, ret, list(close) OVER w AS h FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
  k AS (SELECT *, CASE WHEN len(list_filter(h, lambda x: x IS NOT NULL)) = 5 THEN h END AS g FROM l)
  SELECT date, asset, round((len(list_filter(g, lambda x: x < close)) + (len(list_filter(g, lambda x: x = close)) + 1) / 2.0) / 5, 6) + 0.0 AS ranked,
         CAST(list_position(list_reverse(g), list_max(g)) - 1 AS DOUBLE) AS since_max, CAST(list_position(list_reverse(g), list_min(g)) - 1 AS DOUBLE) AS since_min FROM k"""
)
def factor_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = grammar.with_factors(_panel(spark, sf_dir), {"ranked": "ts_rank(close, 5)", "since_max": "ts_argmax(close, 5)", "since_min": "ts_argmin(close, 5)"})
    return wide.select("date", "asset", *_r("ranked"), "since_max", "since_min")


@_register(
    "WITH " + GRID + """, l AS (SELECT date, asset, close, list(close) FILTER (close IS NOT NULL) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS h FROM panel)
  SELECT date, asset, round(CASE WHEN len(h) >= 6 AND close IS NOT NULL THEN list_reduce(h, lambda s, v: s + (v - s) * (2.0 / 7)) END, 6) + 0.0 AS ema FROM l"""
)
def factor_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.with_factors(_panel(spark, sf_dir), {"ema": "ema(close, 6)"}).select("date", "asset", *_r("ema"))


@_register(
    "WITH " + GRID + """, r AS (SELECT date, asset, volume, CASE WHEN close IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY close NULLS LAST) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(close) OVER (PARTITION BY date) END AS x,
     CASE WHEN volume IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY volume NULLS LAST) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY date) END AS y FROM panel)
  SELECT date, asset, round(CASE WHEN count(x) OVER w = 6 AND count(y) OVER w = 6 THEN covar_samp(x, y) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0) END, 5) + 0.0 AS corr
  FROM r WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""
)
def factor_nested_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.with_factors(_panel(spark, sf_dir), {"corr": "ts_corr(rank(close), rank(volume), 6)"}).select("date", "asset", *_r("corr", digits=5))


# ---- splits in time

_DATES = BARS + ", dates AS (SELECT DISTINCT date FROM bars), pos AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM dates)"


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).distinct()


@_register("WITH " + _DATES + " SELECT date, t1 FROM (SELECT date, lead(date, 3) OVER (ORDER BY date) AS t1 FROM pos) WHERE t1 IS NOT NULL")
def split_label_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pn.label_end_times(_dates(spark, sf_dir), 3)


@_register(
    "WITH " + _DATES + """, lab AS (SELECT date, i, n - 2 AS m, ntile(4) OVER (ORDER BY i) - 1 AS fold FROM pos WHERE i < n - 2),
  span AS (SELECT fold, min(i) AS lo, max(i) AS hi, greatest(2, ceil(0.05 * any_value(m))) AS gap FROM lab GROUP BY 1),
  roles AS (SELECT s.fold, l.date, CASE WHEN l.i BETWEEN lo AND hi THEN 'test' WHEN l.i + 2 <= lo OR l.i >= hi + 2 + gap THEN 'train' END AS role FROM lab l CROSS JOIN span s)
  SELECT CAST(fold AS INTEGER) AS fold, date, role FROM roles WHERE role IS NOT NULL"""
)
def split_purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.purged_kfold(_dates(spark, sf_dir), 4, 2, embargo_pct=0.05)


@_register(
    "WITH " + _DATES + """, w AS (SELECT k AS fold, (n - 1) - 4 * ((n - 1) // 5) + k * ((n - 1) // 5) AS lo, (n - 1) // 5 AS size FROM (SELECT any_value(n) AS n FROM pos), range(4) t(k)),
  roles AS (SELECT w.fold, p.date, CASE WHEN p.i >= lo AND p.i < lo + size THEN 'test' WHEN p.i <= lo - 1 THEN 'train' END AS role FROM pos p CROSS JOIN w WHERE p.i < p.n - 1)
  SELECT CAST(fold AS INTEGER) AS fold, date, role FROM roles WHERE role IS NOT NULL"""
)
def split_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.walk_forward(_dates(spark, sf_dir))


@_register(
    "WITH " + _DATES + """, spans AS (SELECT date, i AS a, i + 3 AS b FROM pos WHERE i + 3 < n), days AS (SELECT date, unnest(range(a + 1, b + 1)) AS j FROM spans),
  many AS (SELECT date, 1.0 / count(*) OVER (PARTITION BY j) AS u FROM days) SELECT date, round(avg(u), 6) + 0.0 AS uniqueness FROM many GROUP BY 1"""
)
def split_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = _dates(spark, sf_dir)
    return validation.average_uniqueness(pn.label_end_times(dates, 3), dates).select("date", *_r("uniqueness"))


_CSCV = (
    "WITH " + _net_sql() + """, r0 AS (SELECT candidate, date, net AS ret FROM net WHERE net IS NOT NULL), ok AS (SELECT date FROM r0 GROUP BY 1 HAVING count(DISTINCT candidate) = 4),
  p AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM ok), b AS (SELECT date, i // (n // 8) AS block FROM p WHERE i // (n // 8) < 8),
  bm AS (SELECT candidate, block, sum(ret) AS s, sum(ret * ret) AS q, count(*) AS n FROM r0 JOIN b USING (date) GROUP BY 1, 2),
  masks AS (SELECT m AS mask FROM range(256) t(m) WHERE bit_count(m) = 4),
  halves AS (SELECT mask, candidate, sum(CASE WHEN (mask >> block) & 1 = 1 THEN s END) AS s1, sum(CASE WHEN (mask >> block) & 1 = 1 THEN q END) AS q1, sum(CASE WHEN (mask >> block) & 1 = 1 THEN n END) AS n1,
                    sum(CASE WHEN (mask >> block) & 1 = 0 THEN s END) AS s0, sum(CASE WHEN (mask >> block) & 1 = 0 THEN q END) AS q0, sum(CASE WHEN (mask >> block) & 1 = 0 THEN n END) AS n0 FROM masks CROSS JOIN bm GROUP BY 1, 2),
  sh AS (SELECT mask, candidate, s1 / n1 / sqrt((q1 / n1 - s1 / n1 * s1 / n1) * n1 / (n1 - 1)) * sqrt(12) AS is_sharpe, s0 / n0 / sqrt((q0 / n0 - s0 / n0 * s0 / n0) * n0 / (n0 - 1)) * sqrt(12) AS oos_sharpe FROM halves),
  rk AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY is_sharpe DESC, candidate) AS best, rank() OVER (PARTITION BY mask ORDER BY oos_sharpe) AS r, count(*) OVER (PARTITION BY mask) AS m FROM sh),
  win AS (SELECT mask, candidate AS winner, is_sharpe, oos_sharpe, r / (m + 1.0) AS rank FROM rk WHERE best = 1)"""
)


@_register(_CSCV + f" SELECT mask, winner, {_rs('is_sharpe', 'oos_sharpe', 'rank', digits=5)} FROM win")
def overfit_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.cscv_splits(_returns(spark, sf_dir).where("ret is not null"), 8, periods=12).select("mask", "winner", *_r("is_sharpe", "oos_sharpe", "rank", digits=5))


@_register(_CSCV + " SELECT round(avg(CASE WHEN rank < 0.5 THEN 1.0 WHEN rank = 0.5 THEN 0.5 ELSE 0.0 END), 5) + 0.0 AS pbo, count(*) AS n_splits, round(regr_slope(oos_sharpe, is_sharpe), 5) + 0.0 AS slope, round(regr_intercept(oos_sharpe, is_sharpe), 5) + 0.0 AS intercept, round(avg(CASE WHEN oos_sharpe < 0 THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS loss_share FROM win")
def overfit_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.pbo(validation.cscv_splits(_returns(spark, sf_dir).where("ret is not null"), 8, periods=12)).select(*_r("pbo", digits=5), "n_splits", *_r("slope", "intercept", "loss_share", digits=5))


# ---- everything else is registered by the modules below

from panelyard import factor_queries, feed_queries, log_queries, more_queries, plant_queries, release_queries, search_queries  # noqa: E402


def _asset_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("date", F.col("asset").alias("candidate"), "ret")


more_queries.register(_register)
search_queries.register(_register, GRID)
plant_queries.register(_register, GRID)
factor_queries.register(_register)
feed_queries.register(_register)
release_queries.register(_register)
log_queries.register(_register, GRID, PVALUES, _pvalues, _RET, _asset_returns)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

