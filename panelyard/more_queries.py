"""Queries over market-data rules, ledgers, the document log, vectors and monitors, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions import text
from panelyard.operators import ledger, market_data, monitor, papers, validation
from panelyard.session import rounded, table

#: One row for each supplier and ship day, with flags that follow from its line numbers, so that every rule is met.
DAILY = """d0 AS (SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_linenumber) AS BIGINT) AS k, avg(l_discount) AS disc, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY 1, 2),
  daily AS (SELECT permno, date, k, CASE WHEN k % 4 > 0 THEN disc - 0.05 END AS dlyret,
     CASE WHEN k % 8 = 0 THEN 'NT' WHEN k % 8 = 4 AND k % 3 > 0 THEN 'NS' WHEN k % 4 = 0 THEN 'DG' ELSE 'NA' END AS dlyretmissflg,
     CASE WHEN k % 12 = 0 THEN 'Y' ELSE 'N' END AS dlydelflg, CASE WHEN k % 24 = 0 THEN 'GDR' WHEN k % 36 = 0 THEN 'MER' END AS delactiontype,
     CASE WHEN k % 5 > 0 THEN price * (1 - disc / 4) END AS dlybid, CASE WHEN k % 7 > 0 THEN price * (1 + disc / 4) END AS dlyask,
     CASE WHEN k % 11 = 0 THEN NULL ELSE k % 2 = 0 END AS in_universe FROM d0)"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("permno"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_linenumber").alias("k"), F.avg("l_discount").alias("disc"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    e = F.expr
    return d.select(
        "permno", "date", "k", e("case when k % 4 > 0 then disc - 0.05d end").alias("dlyret"),
        e("case when k % 8 = 0 then 'NT' when k % 8 = 4 and k % 3 > 0 then 'NS' when k % 4 = 0 then 'DG' else 'NA' end").alias("dlyretmissflg"),
        e("case when k % 12 = 0 then 'Y' else 'N' end").alias("dlydelflg"), e("case when k % 24 = 0 then 'GDR' when k % 36 = 0 then 'MER' end").alias("delactiontype"),
        e("case when k % 5 > 0 then price * (1 - disc / 4) end").alias("dlybid"), e("case when k % 7 > 0 then price * (1 + disc / 4) end").alias("dlyask"),
        e("case when k % 11 = 0 then null else k % 2 = 0 end").alias("in_universe"),
    )


SPELLS = "spells AS (SELECT o_custkey AS permno, CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS ending FROM orders GROUP BY o_custkey, o_orderstatus)"


def _spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("permno"), "o_orderstatus").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("ending")).drop("o_orderstatus")


PREFILTER = (("the", "of"), ("loser", "idiot", "license", "rights"))
_TITLE = "trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\pL\\pN\\pM]+', ' ', 'g'))"


def register(add: Callable) -> None:
    @add(
        "WITH " + DAILY + """, l AS (SELECT *, coalesce(lag(dlyretmissflg) OVER (PARTITION BY permno ORDER BY date), 'NT') AS before FROM daily)
      SELECT permno, date, round(CASE WHEN dlyret IS NOT NULL THEN dlyret WHEN dlyretmissflg = 'NT' AND before <> 'NT' THEN -0.5
        WHEN dlydelflg = 'Y' AND permno IN (11786, 90090) THEN -1.0 WHEN dlydelflg = 'Y' AND delactiontype IN ('GDR', 'GLI', 'GEX') THEN -0.5 WHEN dlyretmissflg IN ('NS', 'MP') THEN 0.0 END, 6) + 0.0 AS ret FROM l"""
    )
    def market_daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
        return market_data.daily_returns(_daily(spark, sf_dir)).select("permno", "date", rounded("ret").alias("ret"))

    @add(
        "WITH " + DAILY + """, q AS (SELECT *, CASE WHEN dlybid > 0 AND dlyask > dlybid AND (dlyask - dlybid) / ((dlyask + dlybid) / 2) <= 0.05 THEN (dlyask - dlybid) / ((dlyask + dlybid) / 2) END AS s FROM daily),
      t AS (SELECT *, CASE WHEN count(s) OVER w >= 5 THEN quantile_cont(s, 0.5) OVER w END AS behind, quantile_cont(CASE WHEN coalesce(in_universe, false) THEN s END, 0.5) OVER (PARTITION BY date) AS day
            FROM q WINDOW w AS (PARTITION BY permno ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING))
      SELECT permno, date, round(coalesce(s, behind, day), 6) + 0.0 AS spread FROM t"""
    )
    def market_quoted_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
        return market_data.quoted_spread(_daily(spark, sf_dir)).select("permno", "date", rounded("spread").alias("spread"))

    @add(
        """WITH f AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS datadate, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + 30 END AS rdq FROM orders),
      days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), b AS (SELECT *, coalesce(rdq, datadate + 90) AS base FROM f)
      SELECT o_orderkey, datadate, day AS available FROM b ASOF LEFT JOIN days ON b.base < days.day"""
    )
    def market_available_from(spark: SparkSession, sf_dir: str) -> DataFrame:
        day = F.to_date("o_orderdate")
        facts = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("datadate"), F.when(F.col("o_orderkey") % 3 > 0, F.date_add(day, 30)).alias("rdq"))
        days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
        return market_data.available_from(facts, days).select("o_orderkey", "datadate", "available")

    @add(
        """SELECT c_custkey AS lpermno, CASE WHEN c_custkey % 4 = 0 THEN 'LU' WHEN c_custkey % 4 = 1 THEN 'LC' ELSE 'NR' END AS linktype, coalesce(CASE WHEN c_nationkey % 5 > 0 THEN DATE '2000-01-01' + CAST(c_nationkey AS INTEGER) END, DATE '9999-12-31') AS linkenddt
      FROM customer WHERE c_custkey % 4 IN (0, 1) AND c_mktsegment IN ('BUILDING', 'MACHINERY')"""
    )
    def market_primary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("lpermno"), F.expr("case c_custkey % 4 when 0 then 'LU' when 1 then 'LC' else 'NR' end").alias("linktype"),
            F.expr("case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'P' else 'J' end").alias("linkprim"), F.expr("case when c_nationkey % 5 > 0 then date_add(date'2000-01-01', c_nationkey) end").alias("linkenddt"),
        )
        return market_data.primary_links(c).select("lpermno", "linktype", "linkenddt")

    @add("WITH " + SPELLS + " SELECT o_orderkey, EXISTS (SELECT 1 FROM spells s WHERE s.permno = o_custkey + 1 AND CAST(o_orderdate AS DATE) BETWEEN s.start AND s.ending) AS in_index FROM orders")
    def market_member_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 1).alias("permno"), F.to_date("o_orderdate").alias("date"))
        return market_data.member_flag(facts, _spells(spark, sf_dir)).select("o_orderkey", "in_index")

    @add(
        "WITH " + SPELLS + """ SELECT permno, start, least(ending, DATE '1999-12-31') AS ending, ending >= least(DATE '1999-12-31', (SELECT max(ending) FROM spells)) AS censored
      FROM spells WHERE ending >= DATE '1997-01-01' AND start <= DATE '1999-12-31'"""
    )
    def market_spells_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
        return market_data.spells_in(_spells(spark, sf_dir), "1997-01-01", "1999-12-31").select("permno", "start", "ending", "censored")

    @add(
        """WITH a AS (SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2), last AS (SELECT permno, max(date) AS l FROM a GROUP BY 1),
      d AS (SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, max(l_discount) AS dlret FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2), near AS (SELECT d.* FROM d JOIN last USING (permno) WHERE d.date >= l AND d.date - l <= 10)
      SELECT coalesce(a.permno, near.permno) AS permno, coalesce(a.date, near.date) AS date, n, dlret FROM a FULL OUTER JOIN near ON a.permno = near.permno AND a.date = near.date"""
    )
    def market_admit_delistings(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("permno"), F.to_date("l_shipdate").alias("date"), "l_returnflag", "l_discount")
        admitted = rows.where("l_returnflag <> 'N'").groupBy("permno", "date").agg(F.count("*").alias("n"))
        gone = rows.where("l_returnflag = 'N'").groupBy("permno", "date").agg(F.max("l_discount").alias("dlret"))
        return market_data.admit_delistings(admitted, gone).select("permno", "date", "n", "dlret")

    @add("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN p_brand END AS p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
    def market_attach_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_partkey").alias("p_partkey"))
        return market_data.attach(facts, table(spark, sf_dir, "part"), "p_partkey", ["p_brand"], "l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "p_brand")

    @add(
        "WITH " + DAILY + """, u AS (SELECT permno, date, k, CASE WHEN k % 9 = 0 THEN 'D' ELSE 'A' END AS status, CASE WHEN k % 9 = 0 THEN 'N/A' WHEN k % 6 = 1 THEN 'AD' ELSE 'NS' END AS sharetype, CASE WHEN k % 9 = 0 THEN 'X' WHEN k % 7 = 2 THEN 'B' ELSE 'N' END AS primaryexch FROM daily),
      j AS (SELECT *, last_value(CASE WHEN status <> 'D' THEN sharetype END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN status <> 'D' THEN primaryexch END IGNORE NULLS) OVER w AS e FROM u WINDOW w AS (PARTITION BY permno ORDER BY date ROWS UNBOUNDED PRECEDING))
      SELECT permno, date, coalesce(s = 'NS' AND e IN ('N', 'A', 'Q'), false) AND k % 2 = 0 AS in_universe FROM j"""
    )
    def market_universe_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = F.expr
        u = _daily(spark, sf_dir).select(
            "permno", "date", e("case when k % 9 = 0 then 'D' else 'A' end").alias("tradingstatusflg"), e("case when k % 9 = 0 then 'N/A' when k % 6 = 1 then 'AD' else 'NS' end").alias("sharetype"),
            F.lit("EQTY").alias("securitytype"), F.lit("COM").alias("securitysubtype"), F.lit("Y").alias("usincflg"), F.lit("ACOR").alias("issuertype"),
            e("case when k % 9 = 0 then 'X' when k % 7 = 2 then 'B' else 'N' end").alias("primaryexch"), e("k % 2 = 0").alias("in_sp500"),
        )
        return market_data.universe_flag(u).select("permno", "date", "in_universe")

    @add()
    def market_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _daily(spark, sf_dir).select("permno", "date", "dlyret")
        return market_data.placebo(rows, "permute", 7, "v1")[0]

    # ---- ledgers, over events

    entries = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"

    @add("WITH " + entries + " SELECT CAST(k AS VARCHAR) AS hypothesis, count(*) AS k FROM e WHERE event_type <> 'view' AND k IS NOT NULL GROUP BY 1")
    def ledger_search_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").where("event_type <> 'view'").withColumn("h", F.get_json_object("props", "$.k"))
        return ledger.search_intensity(rows, "h")

    @add("SELECT event_type AS name, count(*) AS entries, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
    def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ledger.stats(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("user")))

    @add("WITH " + entries + " SELECT count(*) AS trials FROM e WHERE event_type = 'click' AND NOT (k % 10 = 3)")
    def ledger_trial_count(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        rows = table(spark, sf_dir, "events").select(
            F.col("event_id").alias("line"), F.col("ts").cast("string").alias("ts_utc"), F.col("event_type").alias("name"), F.col("props").alias("params"),
            F.lit("{}").alias("metrics"), F.array(F.concat(F.lit("k"), (k % 10).cast("string"))).alias("tags"),
        )
        return ledger.trial_count(rows, name="click", exclude_tags=["k3"])

    @add("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
    def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ledger.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "event_type")

    @add(
        """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), users AS (SELECT DISTINCT user_id FROM events), x AS (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS v FROM events GROUP BY 1, 2),
      g AS (SELECT u.user_id, d.date, v FROM users u CROSS JOIN days d LEFT JOIN x ON x.user_id = u.user_id AND x.date = d.date), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS i FROM g),
      m AS (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY date) AS grp FROM n WHERE v IS NULL), c AS (SELECT user_id, grp, count(*) AS c FROM m GROUP BY 1, 2) SELECT user_id, round(avg(c), 6) + 0.0 AS mean_run, count(*) AS runs FROM c GROUP BY 1"""
    )
    def panel_idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), "value")
        x = e.groupBy("user_id", "date").agg(F.sum("value").alias("v"))
        grid = x.select("user_id").distinct().crossJoin(F.broadcast(x.select("date").distinct())).join(x, ["user_id", "date"], "left")
        return validation.mean_idle_run(grid, keys=("user_id",), value="v").select("user_id", rounded("mean_run").alias("mean_run"), "runs")

    # ---- the monitor, over events as live returns

    config = monitor.MonitorConfig(expected_mean=0.5, scale=1.0, alpha=0.05, horizon=40)
    steps = ", ".join(f"sum(sign(x * {b!r}) * ln(1 + abs(x * {b!r}) + x * {b!r} * x * {b!r} / 2) - {b * b / 2!r}) OVER w AS w{i}" for i, b in enumerate(monitor.BETS))
    mix = " + ".join(f"exp(w{i})" for i in range(len(monitor.BETS)))
    process = f"WITH r AS (SELECT CAST(user_id AS VARCHAR) AS strategy, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value / 245.0 - 1 AS r FROM events), x AS (SELECT *, (0.5 - r) / 1.0 AS x FROM r), s AS (SELECT strategy, t, {steps} FROM x WINDOW w AS (PARTITION BY strategy ORDER BY t ROWS UNBOUNDED PRECEDING)), p AS (SELECT strategy, t, ({mix}) / {len(monitor.BETS)} AS e_value FROM s)"

    def live(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("strategy"), t.alias("t"), (F.col("value") / 245.0 - 1).alias("r"))

    @add(process + " SELECT strategy, t, round(ln(e_value), 5) + 0.0 AS log_e FROM p")
    def monitor_e_process(spark: SparkSession, sf_dir: str) -> DataFrame:
        return monitor.e_process(live(spark, sf_dir), config).select("strategy", "t", rounded(F.log("e_value"), 5).alias("log_e"))

    @add(process + " SELECT strategy, CASE WHEN min(CASE WHEN e_value >= 20 OR t >= 40 THEN t END) IS NULL THEN 'continue' WHEN min_by(e_value, CASE WHEN e_value >= 20 OR t >= 40 THEN t END) >= 20 THEN 'retire' ELSE 'keep' END AS decision, min(CASE WHEN e_value >= 20 OR t >= 40 THEN t END) AS at FROM p GROUP BY 1")
    def monitor_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
        return monitor.decisions(live(spark, sf_dir), config).select("strategy", "decision", "at")

    # ---- the document log

    @add(f"SELECT doc_id, {_TITLE} AS title_norm FROM documents")
    def log_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = F.substring_index("text", "\n", 1)
        return table(spark, sf_dir, "documents").select("doc_id", text.normalize_title(first, compatibility=False).alias("title_norm"))

    @add(f"WITH t AS (SELECT doc_id, nullif({_TITLE}, '') AS t FROM documents), f AS (SELECT t, min(doc_id) AS canonical FROM t WHERE t IS NOT NULL GROUP BY 1) SELECT doc_id, coalesce(canonical, doc_id) AS canonical FROM t LEFT JOIN f USING (t)")
    def log_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = F.substring_index("text", "\n", 1)
        rows = table(spark, sf_dir, "documents").select("doc_id", F.nullif(text.normalize_title(first, compatibility=False), F.lit("")).alias("t"))
        return papers.exact_groups(rows, "doc_id", "t")

    @add()
    def log_fuzzy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = F.substring_index("text", "\n", 1)
        rows = table(spark, sf_dir, "documents").select("doc_id", text.normalize_title(first).alias("t")).where("t <> ''").groupBy("t").agg(F.min("doc_id").alias("key"))
        titles = rows.select("key", F.col("t").alias("title_norm"))
        return papers.fuzzy_matches(titles, titles).select("key", "match", rounded("ratio").alias("ratio"))

    @add(
        "SELECT doc_id, (contains(lower(text), 'the') OR contains(lower(text), 'of')) AND (contains(lower(text), 'loser') OR contains(lower(text), 'idiot') OR contains(lower(text), 'license') OR contains(lower(text), 'rights')) AS passes FROM documents"
    )
    def log_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", text.passes(F.lit(""), F.col("text"), *PREFILTER).alias("passes"))

    counted = "text"
    sql_total = []
    for p in text.CREDENTIALS:
        q = p.replace("'", "''")
        sql_total.append(f"len(regexp_extract_all({counted}, '{q}'))")
        counted = f"regexp_replace({counted}, '{q}', '[REDACTED]', 'g')"

    @add(f"SELECT doc_id, md5({counted}) AS clean_md5, {' + '.join(sql_total)} AS hidden FROM documents")
    def log_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.col("text")).cast("binary")).alias("clean_md5"), text.redactions(F.col("text")).cast("long").alias("hidden"))

    @add(
        """WITH p AS (SELECT doc_id AS key, coalesce(quality, 0) * 2 + coalesce(toxic, 0) AS relevance, CASE WHEN quality IS NULL THEN 'new' ELSE 'screened' END AS status, source, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
      s AS (SELECT *, max(relevance) OVER (PARTITION BY source) AS best FROM p WHERE status = 'screened' AND relevance >= 2), g AS (SELECT source AS tag, row_number() OVER (ORDER BY best DESC, source) AS group_place FROM (SELECT DISTINCT source, best FROM s))
      SELECT key, source AS tag, group_place, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, n_chars DESC, key) AS place FROM s JOIN g ON s.source = g.tag"""
    )
    def log_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
            F.col("doc_id").alias("key"), (F.coalesce("quality", F.lit(0)) * 2 + F.coalesce("toxic", F.lit(0))).alias("relevance"), F.when(F.col("quality").isNull(), "new").otherwise("screened").alias("status"),
            F.array("source").alias("tags"), F.col("n_chars").alias("published"),
        )
        return papers.digest_groups(p, 2).select("key", "tag", "group_place", "place")

    @add(
        """WITH p AS (SELECT doc_id AS key, CASE WHEN quality IS NULL THEN 1 ELSE 2 END AS priority, CASE WHEN quality IS NULL THEN -CAST(n_chars AS DOUBLE) ELSE -CAST(quality * 2 + toxic AS DOUBLE) END AS o1 FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR doc_id % 2 = 0),
      f AS (SELECT key, 0 AS priority, CAST(key AS DOUBLE) AS o1 FROM p WHERE key % 50 = 0), u AS (SELECT * FROM f UNION ALL SELECT * FROM p WHERE key % 50 <> 0)
      SELECT key, priority, row_number() OVER (ORDER BY priority, o1, key) AS place FROM u ORDER BY place LIMIT 300"""
    )
    def log_screening_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
        p = d.select(
            F.col("doc_id").alias("key"), F.when(F.col("quality").isNull(), "new").otherwise("screened").alias("status"), F.col("n_chars").cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("screened_at"),
            F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("rubric_version"), (F.col("quality") * 2 + F.col("toxic")).alias("relevance"), F.lit(None).cast("string").alias("published"),
        )
        live_ = p.where((F.col("status") == "new") | (F.col("rubric_version") < 2))
        fresh = live_.where("key % 50 = 0").select("key", F.col("key").alias("ord"))
        return papers.screening_queue(p, fresh, budget=300, rubric=2)

    @add("SELECT count(*) AS n, round(avg(abs(quality - toxic)), 6) + 0.0 AS mean_abs_error FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
    def log_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
        return papers.calibration_error(table(spark, sf_dir, "labels"), human="quality", model="toxic").select("n", rounded("mean_abs_error").alias("mean_abs_error"))

    @add(
        """WITH q AS (SELECT vec_id AS q, embedding AS qv, label % 2 AS ql FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT vec_id AS d, embedding AS dv, label % 2 AS dl FROM embeddings),
      s AS (SELECT q, d, ql, dl, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(dv AS DOUBLE[])) AS sim FROM q JOIN d ON q <> d), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS r FROM s),
      f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r) AS k FROM r WHERE r <= 5 AND sim >= 0.2 AND ql <> dl AND d < q) SELECT q AS key, d AS duplicate_of, round(sim, 5) + 0.0 AS sim FROM f WHERE k = 1"""
    )
    def log_cross_language_links(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), F.when(F.col("label") % 2 == 0, "en").otherwise("zh").alias("language"))
        return papers.cosine_links(e.where("key % 20 = 0"), e, threshold=0.2).select("key", "duplicate_of", rounded("sim", 5).alias("sim"))

    @add(f"SELECT role, count(*) AS turns, CAST(sum(CASE WHEN {' + '.join(sql_total)} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_keys, CAST(sum(length({counted})) AS BIGINT) AS clean_chars FROM conversations GROUP BY 1")
    def log_session_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
        said = table(spark, sf_dir, "conversations").select("role", text.redactions(F.col("text")).alias("hidden"), F.length(text.redact(F.col("text"))).alias("n"))
        return said.groupBy("role").agg(F.count("*").alias("turns"), F.sum((F.col("hidden") > 0).cast("bigint")).alias("with_keys"), F.sum("n").cast("bigint").alias("clean_chars"))
