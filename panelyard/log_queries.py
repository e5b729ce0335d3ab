"""Queries over the paper log, intake, grading, calibration, orders, the data dictionary and authorities, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions import text
from panelyard.operators import authority, backtest, calibration, dictionary, grading, haircut, intake, ledger, monitor, multiple_testing, orders, paper_log, papers, sharpe, validation
from panelyard.session import rounded, table

E = F.expr

#: Documents as papers: what labels know gives the score, and numbers give what a reviewer did.
PAPERS = """papers AS (SELECT doc_id AS key, CASE WHEN quality IS NULL THEN CASE WHEN doc_id % 9 = 0 THEN 'filtered' ELSE 'new' END WHEN doc_id % 13 = 0 THEN 'adopted' WHEN doc_id % 17 = 0 THEN 'duplicate' ELSE 'screened' END AS status,
    CAST(quality * 2 + toxic AS INTEGER) AS relevance, CASE WHEN doc_id % 6 = 0 THEN CAST(doc_id % 6 + doc_id % 5 AS INTEGER) END AS human_rating, [source, lang] AS tags, CAST(n_chars AS BIGINT) AS published, lang AS title, source AS title_en,
    CAST(doc_id % 3 AS INTEGER) AS rubric_version, CASE WHEN doc_id % 4 = 0 THEN 'taken' END AS taken FROM documents LEFT JOIN labels USING (doc_id))"""


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("key"), E("case when quality is null then case when doc_id % 9 = 0 then 'filtered' else 'new' end when doc_id % 13 = 0 then 'adopted' when doc_id % 17 = 0 then 'duplicate' else 'screened' end").alias("status"),
        E("cast(quality * 2 + toxic as int)").alias("relevance"), E("case when doc_id % 6 = 0 then cast(doc_id % 6 + doc_id % 5 as int) end").alias("human_rating"), F.array("source", "lang").alias("tags"), F.array("source", "lang").alias("sources"),
        F.col("n_chars").cast("bigint").alias("published"), F.col("lang").alias("title"), F.col("source").alias("title_en"), F.lit(None).cast("string").alias("abstract"), F.lit(None).cast("string").alias("summary_en"),
        E("cast(doc_id % 3 as int)").alias("rubric_version"), E("case when doc_id % 4 = 0 then timestamp '2024-01-01 00:00:00' end").alias("ingested_at"), F.lit(None).cast("timestamp").alias("screened_at"), F.lit("v1").alias("prefilter_version"),
    )


def _identified(rows: DataFrame, key: str) -> DataFrame:
    """Rows as papers with identifiers, of which some are shared."""
    return rows.select(F.col(key).alias("key"), E(f"case when {key} % 3 = 0 then cast({key} div 6 as string) end").alias("arxiv_id"), E(f"case when {key} % 5 = 0 then concat('10.1/', {key} div 10) end").alias("doi"), E(f"concat('title ', chr(cast(97 + {key} % 26 as int)), ' ', chr(cast(97 + {key} div 26 % 26 as int)))").alias("title_norm"))


_IDENTIFIED = "CASE WHEN {k} % 3 = 0 THEN CAST({k} // 6 AS VARCHAR) END AS arxiv_id, CASE WHEN {k} % 5 = 0 THEN '10.1/' || ({k} // 10) END AS doi, 'title ' || chr(CAST(97 + {k} % 26 AS INTEGER)) || ' ' || chr(CAST(97 + {k} // 26 % 26 AS INTEGER)) AS title_norm"


def register(add: Callable, grid: str, pvalues: str, spark_pvalues: Callable[[SparkSession, str], DataFrame], returns_sql: str, spark_returns: Callable[[SparkSession, str], DataFrame]) -> None:
    W = f"WITH {PAPERS}"

    # ---- the paper log

    @add(W + " SELECT key, relevance, status FROM papers WHERE status NOT IN ('filtered', 'duplicate') AND coalesce(relevance, 0) >= 1 AND status IN ('screened', 'adopted') AND published >= 200 AND (contains(title, 'e') OR contains(title_en, 'e')) AND (list_contains(tags, 'en') OR list_contains(tags, 'fr'))")
    def log_select(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paper_log.select(_papers(spark, sf_dir), min_relevance=1, status=["screened", "adopted"], since=200, search="E", tags=["en", "fr"]).select("key", "relevance", "status")

    @add(W + " SELECT key, relevance FROM papers WHERE status = 'adopted'")
    def log_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paper_log.adopted(_papers(spark, sf_dir)).select("key", "relevance")

    @add(W + " SELECT key, relevance FROM papers WHERE taken IS NULL AND status IN ('screened', 'read', 'adopted') AND relevance >= 1 ORDER BY relevance DESC, published DESC, key LIMIT 100")
    def log_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paper_log.pending(_papers(spark, sf_dir), min_relevance=1, limit=100).select("key", "relevance")

    @add(W + " SELECT key, taken IS NOT NULL OR key % 7 = 0 AS taken FROM papers")
    def log_mark_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _papers(spark, sf_dir)
        return paper_log.mark_ingested(p, p.where("key % 7 = 0"), "2024-02-01 00:00:00").select("key", F.col("ingested_at").isNotNull().alias("taken"))

    @add(W + " SELECT count(*) AS papers, count(*) FILTER (coalesce(relevance, 0) >= 2) AS relevant, count(*) FILTER (status = 'adopted') AS adopted, count(*) FILTER (status = 'filtered') AS filtered, count(*) FILTER (status = 'new') AS unscreened FROM papers WHERE status <> 'duplicate'")
    def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paper_log.counts(_papers(spark, sf_dir), 2)

    @add(W + " SELECT source, count(*) AS n FROM (SELECT unnest(tags) AS source FROM papers WHERE status <> 'duplicate') GROUP BY 1")
    def log_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paper_log.by_source(_papers(spark, sf_dir))

    @add(W + " SELECT rubric_version, count(*) AS n FROM papers WHERE relevance IS NOT NULL GROUP BY 1")
    def log_by_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paper_log.by_rubric(_papers(spark, sf_dir))

    @add(W + " SELECT key, relevance, human_rating, human_rating - relevance AS gap FROM papers WHERE human_rating - relevance >= 2 ORDER BY gap DESC, key LIMIT 10")
    def log_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
        return paper_log.misses(_papers(spark, sf_dir))

    @add(W + " SELECT key, relevance AS before, CAST(key % 4 AS INTEGER) AS after, CAST(key % 4 AS INTEGER) - relevance AS move FROM papers WHERE key % 4 <> relevance ORDER BY abs(move) DESC, key LIMIT 20")
    def log_rescreen_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _papers(spark, sf_dir)
        return paper_log.rescreen_moves(p, p.select("key", E("cast(key % 4 as int)").alias("relevance")))

    @add(W + " SELECT key, CASE WHEN status = 'new' AND key % 2 = 0 THEN 'filtered' WHEN status = 'filtered' AND key % 2 = 1 THEN 'new' ELSE status END AS status, CASE WHEN status IN ('new', 'filtered') THEN 'v2' ELSE 'v1' END AS prefilter_version FROM papers")
    def log_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, odd = _papers(spark, sf_dir), E("key % 2 = 1")
        new, old = p.where("status = 'new'"), p.where("status <> 'new'")
        done = paper_log.classify(new, odd, "v2").unionByName(paper_log.revisit_filtered(old, odd, "v2"))
        return done.select("key", "status", "prefilter_version")

    @add(W + ", e AS (SELECT vec_id AS id, vec_id // 3 AS key, label AS relevance FROM embeddings), l AS (SELECT key, max_by(relevance, id) AS r FROM e GROUP BY 1) SELECT papers.key, coalesce(l.r, relevance) AS relevance, CASE WHEN l.key IS NOT NULL AND status <> 'adopted' THEN 'screened' ELSE status END AS status FROM papers LEFT JOIN l USING (key)")
    def log_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), E("vec_id div 3").alias("key"), F.col("label").alias("relevance"), F.array(F.lit("x")).alias("tags"), F.lit("s").alias("summary_en"), F.lit(2).alias("rubric_version"), F.lit(None).cast("timestamp").alias("screened_at"))
        return paper_log.save(_papers(spark, sf_dir), ev).select("key", "relevance", "status")

    @add(
        f"""WITH k AS (SELECT o_orderkey AS key, {_IDENTIFIED.format(k="o_orderkey")} FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey AS key, {_IDENTIFIED.format(k="o_orderkey")} FROM orders WHERE o_orderstatus = 'O'),
      a AS (SELECT arxiv_id, min(key) AS k FROM k WHERE arxiv_id IS NOT NULL GROUP BY 1), d AS (SELECT doi, min(key) AS k FROM k WHERE doi IS NOT NULL GROUP BY 1),
      t AS (SELECT b.key, min(k.key) AS k FROM b JOIN k USING (title_norm) WHERE NOT (coalesce(b.arxiv_id <> k.arxiv_id, false) OR coalesce(b.doi <> k.doi, false)) GROUP BY 1)
      SELECT b.key, coalesce(a.k, d.k, t.k) AS existing FROM b LEFT JOIN a ON b.arxiv_id = a.arxiv_id LEFT JOIN d ON b.doi = d.doi LEFT JOIN t ON b.key = t.key"""
    )
    def log_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders")
        return papers.find_existing(_identified(rows.where("o_orderstatus = 'O'"), "o_orderkey"), _identified(rows.where("o_orderstatus = 'F'"), "o_orderkey"))

    @add()
    def log_batch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = F.substring_index("text", "\n", 1)
        rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), text.normalize_title(first).alias("title_norm"), E("case when doc_id % 11 = 0 then cast(doc_id div 22 as string) end").alias("arxiv_id"), F.lit(None).cast("string").alias("doi"), F.col("doc_id").alias("ord"))
        return paper_log.dedupe_batch(rows)

    raw_doi = "CASE WHEN o_orderkey % 3 = 0 THEN ' https://doi.org/10.1/AB' || o_orderkey WHEN o_orderkey % 3 = 1 THEN '10.2/X' || o_custkey END"
    raw_arxiv = "CASE WHEN o_orderkey % 4 = 0 THEN 'arXiv:2401.' || (10000 + o_orderkey % 90000) || 'v2' WHEN o_orderkey % 4 = 1 THEN 'https://arxiv.org/pdf/2402.' || (10000 + o_orderkey % 90000) || '.pdf' END"

    @add(
        f"""WITH i AS (SELECT o_orderkey AS id, nullif(regexp_replace(lower(trim({raw_doi})), '^https?://(dx\\.)?doi\\.org/', ''), '') AS doi, nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({raw_arxiv})), '^(arxiv:|https?://arxiv\\.org/(abs|pdf)/)', ''), 'v\\d+$', ''), '\\.pdf$', ''), '') AS arxiv FROM orders)
      SELECT id, doi, arxiv, coalesce('arxiv:' || arxiv, 'doi:' || doi, substr(sha1('title ' || id), 1, 16)) AS paper_key FROM i"""
    )
    def log_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.normalize_doi(E(raw_doi)).alias("doi"), text.normalize_arxiv(E(raw_arxiv)).alias("arxiv"))
        return o.withColumn("paper_key", text.paper_key(F.col("arxiv"), F.col("doi"), F.concat(F.lit("title "), F.col("id").cast("string"))))

    @add("SELECT o_orderkey AS id, CASE WHEN length(c) <= 4 THEN repeat('*', CAST(length(c) AS INTEGER)) ELSE left(c, 2) || repeat('*', CAST(length(c) - 4 AS INTEGER)) || right(c, 2) END AS account, 'http://x/?api_key=***&k=1' AS url FROM (SELECT o_orderkey, CAST(o_custkey * 37 AS VARCHAR) AS c FROM orders)")
    def log_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = table(spark, sf_dir, "orders")
        return o.select(F.col("o_orderkey").alias("id"), text.mask_account(E("cast(o_custkey * 37 as string)")).alias("account"), text.redact_url(F.concat(F.lit("http://x/?api_key="), F.col("o_orderkey").cast("string"), F.lit("&k=1"))).alias("url"))

    @add("SELECT coalesce(CAST(max(CASE WHEN o_totalprice > 1000 THEN o_orderdate END) AS DATE) - 3, DATE '2024-01-01' - 30) AS since FROM orders")
    def log_next_since(spark: SparkSession, sf_dir: str) -> DataFrame:
        runs = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("started_at"), E("case when o_totalprice > 1000 then 1 else 0 end").alias("fetched"))
        return paper_log.next_since(runs, overlap_days=3, default_days=30, today="2024-01-01")

    # ---- the ledger's views

    @add("SELECT event_id AS line, event_type AS name FROM events ORDER BY event_id DESC LIMIT 20")
    def ledger_last_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ledger.last_entries(table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.col("event_type").alias("name")), 20)

    # ---- intake

    base = f"WITH {grid}, r AS (SELECT p.date, p.asset AS candidate, CASE WHEN p.asset % 10 = 9 AND p.date >= DATE '1996-01-01' THEN NULL ELSE p.ret END AS ret FROM panel p)"
    families_sql = "f AS (SELECT s_suppkey + CASE WHEN s_suppkey % 7 = 0 THEN 1000000 ELSE 0 END AS candidate, s_nationkey AS family FROM supplier)"

    def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark_returns(spark, sf_dir)
        return rows.select("date", "candidate", E("case when candidate % 10 = 9 and date >= date '1996-01-01' then null else ret end").alias("ret"))

    @add(base + ", " + families_sql + " SELECT 'no family' AS problem, CAST(candidate AS VARCHAR) AS offender FROM (SELECT DISTINCT candidate FROM r) WHERE candidate NOT IN (SELECT candidate FROM f) UNION ALL SELECT 'label of an unknown candidate', CAST(candidate AS VARCHAR) FROM f WHERE candidate NOT IN (SELECT candidate FROM r)")
    def intake_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = table(spark, sf_dir, "supplier").select(E("s_suppkey + case when s_suppkey % 7 = 0 then 1000000 else 0 end").alias("candidate"), F.col("s_nationkey").alias("family"))
        return intake.problems(batch(spark, sf_dir), labels)

    @add(base + " SELECT * FROM (SELECT 'search' AS period, candidate, count(CASE WHEN date <= DATE '1995-03-31' THEN ret END) AS n FROM r GROUP BY 2 UNION ALL SELECT 'holdout', candidate, count(CASE WHEN date >= DATE '1997-01-01' THEN ret END) FROM r GROUP BY 2) WHERE n < 2")
    def intake_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
        return intake.period_shortfalls(batch(spark, sf_dir), "1995-03-31", "1997-01-01")

    # ---- grading, corrections and calibration

    P = f"WITH {pvalues}"

    @add(P + ", d AS (SELECT p, coalesce(p <= 0.05, false) AS rejected, candidate % 10 = 0 AS truth FROM pv) SELECT round(count(*) FILTER (rejected AND NOT truth) / nullif(count(*) FILTER (rejected), 0), 6) + 0.0 AS fdr, round(count(*) FILTER (rejected AND truth) / nullif(count(*) FILTER (truth), 0), 6) + 0.0 AS power FROM d")
    def correct_fdr_and_power(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = spark_pvalues(spark, sf_dir).select(F.coalesce(F.col("p") <= 0.05, F.lit(False)).alias("rejected"), (F.col("candidate") % 10 == 0).alias("truth"))
        return multiple_testing.false_discovery_rate(d).crossJoin(multiple_testing.power(d)).select(rounded("fdr").alias("fdr"), rounded("power").alias("power"))

    @add(P + ", s AS (SELECT max(CASE WHEN p <= 0.05 THEN p END) AS t, count(p) AS m, count(*) FILTER (p > 0.5) AS above FROM pv), r AS (SELECT *, (SELECT count(*) FROM pv, s WHERE p <= t) AS r FROM s) SELECT round(least(1.0, above / (0.5 * m)) * t / (greatest(r / m, 1.0 / m) * (1 - pow(1 - t, m))), 6) + 0.0 AS estimate FROM r")
    def grading_search_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grading.search_fdr(spark_pvalues(spark, sf_dir).select(F.col("p").alias("p1"), F.coalesce(F.col("p") <= 0.05, F.lit(False)).alias("passed"))).select(rounded("estimate").alias("estimate"))

    @add(P + ", a AS (SELECT candidate AS family, coalesce(p, 1.0) AS p FROM pv WHERE candidate % 3 = 0), k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM a), x AS (SELECT family, least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS s FROM k) SELECT candidate AS family, round(s, 6) + 0.0 AS stage4_stat FROM pv LEFT JOIN x ON x.family = pv.candidate")
    def grading_stage4(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats = spark_pvalues(spark, sf_dir).select(F.col("candidate").alias("family"), F.col("p").alias("ho_p"), E("candidate % 3 = 0").alias("stage3"))
        return grading.stage4_statistic(stats).select("family", rounded("stage4_stat").alias("stage4_stat"))

    @add("SELECT s_suppkey AS family, round(least(CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal * greatest(s_nationkey / 10.0 - 0.5, 0) / 1.0 END, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal / 2 END, s_acctbal), 6) + 0.0 AS expected FROM supplier")
    def grading_expected_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = table(spark, sf_dir, "supplier")
        value = grading.expected_mean(E("case when s_suppkey % 4 > 0 then s_nationkey / 10.0d - 0.5d end"), F.lit(1.0), F.col("s_acctbal"), E("case when s_suppkey % 3 > 0 then s_acctbal / 2 end"))
        return s.select(F.col("s_suppkey").alias("family"), rounded(value).alias("expected"))

    @add()
    def grading_haircut(spark: SparkSession, sf_dir: str) -> DataFrame:
        tests = sharpe.sharpe_test(spark_returns(spark, sf_dir), method="normal", periods=12).select("candidate", "sharpe", "n_obs")
        out = haircut.haircut_sharpe(tests, 300, n_simulations=400)
        return out.select("candidate", "n_obs", *[rounded(c).alias(c) for c in ("sharpe_annualized", "pvalue", "pvalue_bonferroni", "pvalue_holm", "pvalue_bhy", "sharpe_average", "haircut_average")])

    @add()
    def grading_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark_returns(spark, sf_dir)
        tests = sharpe.sharpe_test(rows, method="normal", periods=12)
        best = tests.select(F.col("candidate").alias("family"), "candidate", F.col("pvalue_greater").alias("p1"))
        out = grading.graded_scores(rows, best, 300, 0.1, n_simulations=200, periods=12)
        return out.select("family", *[rounded(c).alias(c) for c in ("p1", "by", "holm", "lfdr", "sharpe", "psr", "min_trl_years", "haircut_sharpe")])

    @add()
    def correct_local_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
        return multiple_testing.evidence_profile(spark_pvalues(spark, sf_dir), with_lfdr=True).select("candidate", *[rounded(c).alias(c) for c in ("p", "q", "lfdr")])

    runs = "runs AS (SELECT 'r' || (l_suppkey % 5) AS rule, CAST(l_linenumber % 3 AS INTEGER) AS n_real, CAST(l_linenumber AS DOUBLE) AS sharpe, CAST(l_quantity AS BIGINT) AS discoveries, CAST(least(l_linenumber % 3, l_quantity) AS BIGINT) AS true_, CAST(greatest(l_quantity - 40, 0) AS BIGINT) AS false_ FROM lineitem)"

    @add(
        f"""WITH {runs}, x AS (SELECT *, false_ / greatest(discoveries, 1) AS fdp, CASE WHEN n_real > 0 THEN true_ / n_real END AS power FROM runs), s AS (SELECT rule, n_real, sharpe, avg(fdp) AS fdr, avg(power) AS power, avg(CASE WHEN false_ > 0 THEN 1.0 ELSE 0.0 END) AS any_false, max(false_) AS worst FROM x GROUP BY 1, 2, 3)
      SELECT rule, round(max(fdr), 6) + 0.0 AS worst_fdr, round(avg(power), 6) + 0.0 AS mean_power, round(arg_min(any_false, (n_real, sharpe)), 6) + 0.0 AS null_any_false, max(worst) AS worst_false, max(fdr) <= 0.04 AS safe FROM s GROUP BY 1"""
    )
    def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = table(spark, sf_dir, "lineitem")
        rows = li.select(E("concat('r', l_suppkey % 5)").alias("rule"), E("cast(l_linenumber % 3 as int)").alias("n_real"), F.col("l_linenumber").cast("double").alias("sharpe"), F.col("l_quantity").cast("bigint").alias("discoveries"), E("cast(least(l_linenumber % 3, l_quantity) as bigint)").alias("true"), E("cast(greatest(l_quantity - 40, 0) as bigint)").alias("false"))
        return calibration.summarise(rows, 0.05, 0.01).select("rule", *[rounded(c).alias(c) for c in ("worst_fdr", "mean_power", "null_any_false")], "worst_false", "safe")

    @add("WITH s AS (SELECT l_suppkey % 7 AS thresholds, l_linenumber AS a, l_returnflag AS b, avg(l_discount) AS fdr, avg(l_tax) AS power FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2, 3) SELECT thresholds, round(max(fdr), 6) + 0.0 AS worst_fdr, round(avg(power), 6) + 0.0 AS mean_power FROM s GROUP BY 1 HAVING max(fdr) <= 0.06")
    def calibration_recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = table(spark, sf_dir, "lineitem")
        rows = li.select(E("l_suppkey % 7").alias("thresholds"), F.col("l_linenumber").alias("share_real"), F.col("l_returnflag").alias("sharpe_real"), F.col("l_discount").alias("fdr"), F.col("l_tax").alias("power"), E("case when l_linestatus = 'O' then 'funnel' else 'baseline' end").alias("arm"), F.lit("reuse").alias("design"))
        return calibration.recommend(rows, 0.06).select("thresholds", rounded("worst_fdr").alias("worst_fdr"), rounded("mean_power").alias("mean_power"))

    @add("SELECT l_partkey % 2 = 0 AS truth, round(avg(CASE WHEN d > 0.05 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS gate_a, round(avg(CASE WHEN t > 0.05 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS gate_b FROM (SELECT l_partkey, max(l_discount) AS d, min(l_tax) AS t FROM lineitem GROUP BY 1) GROUP BY 1")
    def calibration_gates_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("family")).agg((F.max("l_discount") > 0.05).alias("gate_a"), (F.min("l_tax") > 0.05).alias("gate_b")).withColumn("truth", E("family % 2 = 0"))
        out = calibration.gates_alone(li.drop("truth"), li.select("family", "truth"), ["gate_a", "gate_b"])
        return out.select("truth", rounded("gate_a").alias("gate_a"), rounded("gate_b").alias("gate_b"))

    @add(
        """WITH c AS (SELECT l_suppkey AS key, CAST(l_linenumber AS DOUBLE) AS x, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(y) OVER (PARTITION BY key ORDER BY x ROWS UNBOUNDED PRECEDING) AS top FROM c),
      p AS (SELECT *, lag(x) OVER w AS x0, lag(top) OVER w AS y0 FROM m WINDOW w AS (PARTITION BY key ORDER BY x)), h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY x) AS r FROM p WHERE top >= 26)
      SELECT c.key, round(CASE WHEN x0 IS NULL THEN h.x ELSE x0 + (26 - y0) * (h.x - x0) / (top - y0) END, 6) + 0.0 AS at FROM (SELECT DISTINCT key FROM c) c LEFT JOIN h ON h.key = c.key AND h.r = 1"""
    )
    def calibration_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
        curve = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_linenumber").cast("double").alias("sharpe")).agg(F.avg("l_quantity").alias("power"))
        return calibration.crossing(curve, 26.0, keys=("key",)).select("key", rounded("at").alias("at"))

    @add("SELECT q1, q4 FROM (SELECT DISTINCT CAST(l_discount AS DOUBLE) AS q1 FROM lineitem WHERE l_discount > 0), (SELECT DISTINCT CAST(l_tax AS DOUBLE) AS q4 FROM lineitem WHERE l_tax > 0)")
    def calibration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every discount as q1 with every tax as q4."""
        rows = table(spark, sf_dir, "lineitem")
        values = lambda c: [r[0] for r in rows.where(f"{c} > 0").select(F.col(c).cast("double")).distinct().collect()]
        return calibration.threshold_grid(spark, q1=values("l_discount"), q4=values("l_tax"))

    @add(returns_sql + ", w AS (SELECT candidate, date, 100 + sum(ret) OVER (PARTITION BY candidate ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM r0) SELECT candidate, date, round(wealth / greatest(100.0, max(wealth) OVER (PARTITION BY candidate ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1, 6) + 0.0 AS drawdown FROM w")
    def backtest_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = panel_net(spark, sf_dir)
        run = Window.partitionBy("candidate").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return backtest.drawdown(rows.withColumn("wealth", 100 + F.sum("ret").over(run)), 100.0).select("candidate", "date", rounded("drawdown").alias("drawdown"))

    @add(f"WITH {grid}, s AS (SELECT *, min(CASE WHEN ret IS NOT NULL THEN date END) OVER (PARTITION BY asset) AS a, max(CASE WHEN ret IS NOT NULL THEN date END) OVER (PARTITION BY asset) AS b FROM panel) SELECT asset AS candidate, date, round(ret, 6) + 0.0 AS ret FROM s WHERE date BETWEEN a AND b")
    def panel_live_span(spark: SparkSession, sf_dir: str) -> DataFrame:
        return validation.trim_live(spark_returns(spark, sf_dir)).select("candidate", "date", rounded("ret").alias("ret"))

    @add("SELECT round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS scale FROM events")
    def monitor_config(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = monitor.from_backtest(table(spark, sf_dir, "events"), value="value")
        return spark.createDataFrame([(c.expected_mean, c.scale)], "mean double, scale double").select(rounded("mean").alias("mean"), rounded("scale").alias("scale"))

    a, b = 0.05, 0.3
    mix = f"({a} * pi0 + {1 - b} * (1 - pi0))"

    @add(
        f"""WITH g AS (SELECT p_brand AS brand, count(*) AS k, 0.5::DOUBLE + 0.45 * avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS pi0 FROM part GROUP BY 1), e AS (SELECT *, 1 - pow(1 - {a}, k) AS alpha_k, pow(pi0, k) AS pi0_k, 1 - pow(1 - {mix}, k) AS hit FROM g),
      f AS (SELECT *, 1 - (hit - alpha_k * pi0_k) / (1 - pi0_k) AS beta_k FROM e) SELECT brand, k, round({a} * pi0 / {mix}, 8) + 0.0 AS fdr, round(alpha_k, 8) + 0.0 AS alpha_k, round(beta_k, 8) + 0.0 AS beta_k,
      round(alpha_k * pi0_k / (alpha_k * pi0_k + (1 - beta_k) * (1 - pi0_k)), 8) + 0.0 AS fdr_k FROM f"""
    )
    def sharpe_search_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Each brand's parts as so many variants tried, its share of large ones as a share of true nulls."""
        share = 0.5 + 0.45 * F.avg(F.when(F.col("p_size") > 25, 1.0).otherwise(0.0))
        brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("k"), share.alias("pi0"))
        return sharpe.with_search_errors(brands, a, b).select("brand", "k", *[rounded(c, 8).alias(c) for c in ("fdr", "alpha_k", "beta_k", "fdr_k")])

    # ---- orders, the dictionary, authorities

    @add("WITH o AS (SELECT s_suppkey AS asset, s_name AS symbol, (s_acctbal / 100000.0) * 50000.0 / (10.0 + s_suppkey % 90) AS x, 10.0 + s_suppkey % 90 AS price FROM supplier), n AS (SELECT asset, symbol, CAST(sign(x) * floor(abs(x) + 0.5) AS BIGINT) AS shares, price FROM o) SELECT asset, symbol, shares, price, round(abs(shares) * price, 4) + 0.0 AS notional FROM n WHERE shares <> 0 AND abs(shares) * price >= 500")
    def orders_whole_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = table(spark, sf_dir, "supplier")
        out = orders.to_share_orders(s.select(F.col("s_suppkey").alias("asset"), (F.col("s_acctbal") / 100000).alias("weight")), s.select(F.col("s_suppkey").alias("asset"), F.col("s_name").alias("symbol"), (10.0 + F.col("s_suppkey") % 90).alias("price")), 50_000, min_notional=500)
        return out.select("asset", "symbol", "shares", "price", rounded("notional", 4).alias("notional"))

    @add(f"WITH {grid}, c AS (SELECT s_suppkey AS asset, DATE '1996-06-01' AS date, s_acctbal AS shares FROM supplier UNION ALL SELECT s_suppkey, DATE '1999-01-15', s_acctbal * 2 FROM supplier WHERE s_suppkey % 2 = 0), j AS (SELECT p.asset, p.date, p.close, (SELECT arg_max(c.shares, c.date) FROM c WHERE c.asset = p.asset AND c.date <= p.date) AS shares FROM panel p) SELECT asset, date, round(shares, 4) + 0.0 AS shares, round(abs(close) * shares, 4) + 0.0 AS cap FROM j")
    def panel_shares_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = table(spark, sf_dir, "supplier")
        reports = s.select(F.col("s_suppkey").alias("asset"), E("date '1996-06-01'").alias("date"), F.col("s_acctbal").alias("shares")).unionByName(s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("asset"), E("date '1999-01-15'").alias("date"), (F.col("s_acctbal") * 2).alias("shares")))
        return orders.daily_shares_cap(spark_panel(spark, sf_dir).select("asset", "date", "close"), reports).select("asset", "date", rounded("shares", 4).alias("shares"), rounded("cap", 4).alias("cap"))

    meanings = [("o_orderstatus", "F", "filled"), ("o_orderstatus", "O", "open"), ("o_orderstatus", "P", "partly filled")]
    told = " ".join(f"WHEN '{c}' THEN '{m}'" for _, c, m in meanings)

    @add(f"WITH c AS (SELECT o_orderstatus AS code, count(*) AS n FROM orders GROUP BY 1) SELECT 'o_orderstatus' AS \"column\", string_agg(code || ': ' || CASE code {told} END, '; ' ORDER BY n DESC, code) AS \"values\" FROM c")
    def dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = spark.createDataFrame(meanings, "column string, code string, meaning string")
        return dictionary.code_values(dictionary.code_counts(table(spark, sf_dir, "orders"), ["o_orderstatus"]), known)

    @add("SELECT 'priced' AS claim, round(avg(CASE WHEN l_extendedprice > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share, avg(CASE WHEN l_extendedprice > 0 THEN 1.0 ELSE 0.0 END) BETWEEN 1.0 AND 1.0 AS holds FROM lineitem UNION ALL SELECT 'discounted', round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 6) + 0.0, avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) BETWEEN 0.0 AND 0.2 FROM lineitem")
    def dictionary_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = {"priced": ("l_extendedprice > 0", 1.0, 1.0), "discounted": ("l_discount >= 0.05", 0.0, 0.2)}
        return dictionary.claims(table(spark, sf_dir, "lineitem"), facts).select("claim", rounded("share").alias("share"), "holds")

    @add("SELECT o_custkey AS protocol, CASE max(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END) WHEN 2 THEN 'spent' WHEN 1 THEN 'authorized' ELSE 'sealed' END AS status FROM orders GROUP BY 1")
    def authority_status(spark: SparkSession, sf_dir: str) -> DataFrame:
        return authority.protocol_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("protocol"), E("case o_orderstatus when 'P' then 'opened' when 'F' then 'authorized' else 'registered' end").alias("event")))

    @add("SELECT o_orderkey AS record_id FROM orders WHERE o_custkey % 3 = 0 AND o_orderdate <= TIMESTAMP '1997-01-01' AND o_orderdate + INTERVAL 900 DAY >= TIMESTAMP '1998-01-01' AND o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-02-01')")
    def authority_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = table(spark, sf_dir, "orders")
        grants = o.select(F.col("o_orderkey").alias("record_id"), E("cast(o_custkey % 3 as string)").alias("vendor"), F.col("o_orderdate").cast("timestamp").alias("start"), E("cast(o_orderdate as timestamp) + interval 900 days").alias("end"), E("case when o_orderkey % 2 = 0 then array('price', 'volume') else array('volume') end").alias("fields"))
        gone = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1997-02-01 00:00:00'").select(F.col("l_orderkey").alias("record_id"), F.col("l_shipdate").cast("timestamp").alias("effective"))
        return authority.covering(grants, gone, vendor="0", start="1997-01-01", end="1998-01-01", fields=["price"], active=True).select("record_id")

    @add("SELECT coalesce(bool_or(o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'), false) AS spent FROM orders")
    def authority_look_spent(spark: SparkSession, sf_dir: str) -> DataFrame:
        return authority.look_spent(table(spark, sf_dir, "orders").select(E("case o_orderstatus when 'P' then 'opened' else 'x' end").alias("event"), E("case when o_orderpriority = '1-URGENT' then array('synthetic') end").alias("tags")))

    @add("SELECT l_orderkey AS look, l_suppkey % 3 AS source, l_linenumber AS at, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_linenumber) = 1 AS allowed FROM lineitem")
    def authority_first_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
        return authority.first_reads(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("look"), E("l_suppkey % 3").alias("source"), F.col("l_linenumber").alias("at")))

    def spark_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
        from panelyard.queries import _panel

        return _panel(spark, sf_dir)

    def panel_net(spark: SparkSession, sf_dir: str) -> DataFrame:
        from panelyard.queries import _returns

        return _returns(spark, sf_dir).where("ret is not null")


