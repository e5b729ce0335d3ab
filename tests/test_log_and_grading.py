from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.functions import normal, text
from panelyard.operators import authority, dictionary, grading, haircut, intake, multiple_testing, orders, paper_log, papers, synth
from panelyard.sources import named


def test_haircut_places_a_p_value_as_plain_loops_do():
    rng = np.random.default_rng(1)
    others = haircut.other_trials(30, *haircut.parameters(0.2), rng)
    m = 31
    harmonic = sum(1 / i for i in range(1, m + 1))
    for p in [1e-9, 0.003, 0.2, 0.999, float(others[4])]:
        merged = sorted([*others.tolist(), p])
        at = merged.index(p)
        holm = min(1.0, max((m - i) * merged[i] for i in range(at + 1)))
        scaled = [merged[i] * m * harmonic / (i + 1) if i < m - 1 else merged[i] for i in range(m)]
        got = haircut.adjusted_among(np.array([p]), others)
        assert got[0][0] == pytest.approx(holm) and got[1][0] == pytest.approx(min(scaled[at:]))
    assert haircut.parameters(0.9)[0] == pytest.approx(0.9) and haircut.parameters(1.5) == haircut.parameters(0.2)


def test_haircut_table(spark):
    rows = spark.createDataFrame([("a", 1.0, 240), ("b", -0.5, 240), ("c", 2.5, 240), ("d", 1.0, 1)], "candidate string, sharpe double, n_obs int")
    got = {r["candidate"]: r for r in haircut.haircut_sharpe(rows, 100, n_simulations=50).collect()}
    p = 2 * normal.t_sf(1.0 / np.sqrt(12) * np.sqrt(240), 239)
    assert got["a"]["pvalue"] == pytest.approx(p) and got["a"]["pvalue_bonferroni"] == pytest.approx(min(1, 99 * p))
    assert got["b"]["pvalue"] is None and got["b"]["sharpe_average"] is None and got["d"]["pvalue"] is None
    assert 0 <= got["c"]["haircut_holm"] < got["a"]["haircut_holm"] <= 1
    with pytest.raises(ValueError):
        haircut.haircut_sharpe(rows, 1)
    assert haircut.haircut_sharpe(rows.limit(0), 100, n_simulations=2).count() == 0


def test_graded_scores_have_every_column(spark):
    returns, _ = synth.make_return_matrix(spark, n_obs=200, n_candidates=6, n_real=2, sharpe_real=3.0)
    best = returns.select("candidate").distinct().select(F.col("candidate").alias("family"), "candidate", F.lit(0.01).alias("p1"))
    rows = grading.graded_scores(returns, best, 50, 0.1, n_simulations=20).collect()
    assert len(rows) == 6 and {"by", "holm", "lfdr", "sharpe", "psr", "min_trl_years", "haircut_sharpe"} <= set(rows[0].asDict())
    assert all(r["lfdr"] is None for r in rows)
    assert grading.search_fdr(best.withColumn("passed", F.lit(False))).first()["estimate"] is None


def test_intake_names_offenders(spark):
    day = datetime.date(2020, 1, 1)
    returns = spark.createDataFrame([(day, "a", 0.1), (day, "a", 0.2), (day, "b", float("inf")), (day, "c", None), (None, "d", 0.1)], "date date, candidate string, ret double")
    family = spark.createDataFrame([("a", "f"), ("b", " "), ("c", "f"), ("c", "g"), ("z", "f")], "candidate string, family string")
    found = {(r["problem"], r["offender"]) for r in intake.problems(returns, family).collect()}
    assert found == {("a date repeats", "a"), ("returns must be finite", "b"), ("blank family", "b"), ("no returns at all", "c"), ("more than one family", "c"), ("a date is missing", "d"), ("no family", "d"), ("label of an unknown candidate", "z")}
    with pytest.raises(ValueError, match="no family"):
        intake.check(returns, family, "hand")
    good = spark.createDataFrame([(day + datetime.timedelta(days=i), c, None if i == 2 else 0.1) for i in range(5) for c in "ab"], "date date, candidate string, ret double")
    labels = spark.createDataFrame([("a", "f"), ("b", "f")], "candidate string, family string")
    batch = intake.from_returns(good, labels, generator="hand", search_end="2020-01-02")
    assert batch.returns.count() == 8 and batch.source == {"n_dropped_rows": 1, "start": "2020-01-01", "end": "2020-01-05"}
    with pytest.raises(ValueError, match="search period"):
        intake.check_periods(good, search_end="2020-01-01")
    intake.check_holdout(good.where("ret is not null"), ["a", "b"], start="2020-01-01")
    with pytest.raises(ValueError, match="not delivered"):
        intake.check_holdout(good, ["a", "b", "q"], start="2020-01-01")


def numberings(spark, titles):
    df = spark.createDataFrame([(t,) for t in set(titles)], "t string")
    return {r["t"]: tuple(r["n"]) for r in df.select("t", text.numbering(F.col("t")).alias("n")).collect()}


def test_alike_titles_against_all_pairs(spark):
    """Equal titles stand as one, and their copies are told apart from titles alike."""
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([5, 12, 30, 60, 190, 205, 400]))).strip() for _ in range(50)]
    titles = base + [t[: len(t) // 2] + r.choice("xyz") + t[len(t) // 2 :] for t in base] + [t[1:] for t in base if len(t) > 25] + base[:7]
    rows = [(i, t) for i, t in enumerate(titles) if t]
    df = spark.createDataFrame(rows, "key int, title_norm string")
    got, n = {(x["a"], x["b"]) for x in papers.alike(df).collect()}, numberings(spark, titles)
    first = {t: i for i, t in reversed(rows)}
    heads = sorted(first.values())
    assert got == {(i, j) for i in heads for j in heads if i < j and n[titles[i]] == n[titles[j]] and text.indel_ratio(titles[i], titles[j]) >= 95}
    assert {(x["a"], x["b"]) for x in papers.copies(df).collect()} == {(first[t], i) for i, t in rows if first[t] != i}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    r = random.Random(2)
    r.shuffle(edges)
    got = {x["key"]: x["component"] for x in papers.components(spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in edges], "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert papers.components(spark.createDataFrame([], "a int, b int")).count() == 0


def plain_dedupe(rows, n):
    """Every paper against all that was ever registered, in order."""
    records, seen, out = [], [], {}
    for key, *mine in rows:
        open_to = [i for i, r in enumerate(records) if not any(x and y and x != y for x, y in zip(mine[1:], r[2:], strict=True))]
        chosen = None
        for kind, value in enumerate(mine):
            holders = [i for k, v, i in seen if value and (k, v) == (kind, value)]
            if chosen is None and holders and holders[0] in open_to:
                chosen = holders[0]
        if chosen is None:
            like = [(-text.indel_ratio(mine[0], records[i][1]), i) for i in open_to if n[mine[0]] == n[records[i][1]]]
            chosen = next((i for ratio, i in sorted(like) if ratio <= -95), None)
        if chosen is None:
            chosen = len(records)
            records.append([key, *mine])
        records[chosen][2:] = [has or new for has, new in zip(records[chosen][2:], mine[1:], strict=True)]
        seen += [(kind, value, chosen) for kind, value in enumerate(records[chosen][1:]) if value]
        out[key] = records[chosen][0]
    return out


def test_batch_duplicates_against_plain_code(spark):
    r = random.Random(8)
    names = ["a long title about markets and agents", "a long title about markets and agentz", "part i of something long enough", "part ii of something long enough", "short one"]
    rows = [(i, r.choice(names) + r.choice(["", "", " again and again"]), r.choice([None, None, "1", "2", "3"]), r.choice([None, None, "10.1/x", "10.1/y"])) for i in range(60)]
    df = spark.createDataFrame([(*x, x[0]) for x in rows] + [(99, "", None, None, 99)], "key int, title_norm string, arxiv_id string, doi string, ord int")
    got = {x["key"]: x["canonical"] for x in paper_log.dedupe_batch(df.repartition(3)).collect()}
    assert got == plain_dedupe(rows, numberings(spark, [x[1] for x in rows]))


def test_stored_batches_merge_into_what_is_known(spark):
    schema = "key string, title_norm string, arxiv_id string, doi string, sources array<string>"
    known = spark.createDataFrame([("k1", "one", "1", None, ["x"]), ("k2", "two", None, "", ["y"])], schema)
    batch = spark.createDataFrame([("b1", "other", "1", "10.1/a", ["z"]), ("b2", "two", None, "10.1/b", ["y"]), ("b3", "new", None, None, ["w"])], schema)
    out, how = paper_log.store_batch(known, batch)
    rows = {r["key"]: r for r in out.collect()}
    assert set(rows) == {"k1", "k2", "b3"}
    assert rows["k1"]["doi"] == "10.1/a" and rows["k1"]["sources"] == ["x", "z"] and rows["k2"]["doi"] == "10.1/b" and rows["k2"]["sources"] == ["y"]
    assert {r["key"]: r["existing"] for r in how.collect()} == {"b1": "k1", "b2": "k2", "b3": None}
    assert len(paper_log.plans("2024-01-01")) == 6


def test_orders_and_guards(spark):
    trades = spark.createDataFrame([(2, 0.1), (1, -0.02), (3, 0.00001)], "asset int, weight double")
    prices = spark.createDataFrame([(1, "A", 10.0), (2, "B", 4.0), (3, "C", 50.0)], "asset int, symbol string, price double")
    got = [tuple(r) for r in orders.to_share_orders(trades, prices, 1000.0, min_notional=5).collect()]
    assert got == [(1, "A", -2, 10.0, 20.0), (2, "B", 25, 4.0, 100.0)]
    with pytest.raises(Exception, match="no valid price"):
        orders.to_share_orders(trades, prices.withColumn("price", F.lit(float("nan"))), 1000.0, min_notional=5).collect()
    with pytest.raises(PermissionError):
        orders.check_paper_account("U1", 4002, allowed=True)
    assert [r[0] for r in spark.createDataFrame([(0.5,), (-0.5,), (2.4,)], "x double").select(orders.whole(F.col("x"))).collect()] == [1, -1, 2]


def test_dictionary(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "code string, n int")
    meanings = spark.createDataFrame([("code", "a", "first")], "column string, code string, meaning string")
    with pytest.raises(Exception, match="no meaning for code=b"):
        dictionary.code_values(dictionary.code_counts(df, ["code"]), meanings).collect()
    described = spark.createDataFrame([("n", "a number")], "column string, description string")
    rows = {r["column"]: r for r in dictionary.build(df, described, ["code"], meanings.unionByName(spark.createDataFrame([("code", "b", "second")], meanings.schema))).collect()}
    assert rows["code"]["values"] == "a: first; b: second" and rows["n"]["description"] == "a number" and rows["code"]["description"] is None


def test_authorities(spark):
    record = authority.grant("v", start="2021-01-01", end="2021-12-31", fields=["b", "a"], by="me")
    grants = spark.createDataFrame([], "record_id string, vendor string, start string, end string, fields array<string>, authorized_by string")
    grants = authority.issue(authority.issue(grants, record), record)
    assert grants.count() == 1
    none = spark.createDataFrame([], "record_id string, effective string")
    window = {"vendor": "v", "start": "2021-02-01", "end": "2021-03-01", "fields": ["a"]}
    authority.require(grants, none, record["record_id"], **window)
    gone = spark.createDataFrame([(record["record_id"], "2021-06-01")], none.schema)
    authority.require(grants, gone, record["record_id"], **window)
    for bad in ({"active": True}, {"fields": ["z"]}, {"end": "2022-01-01"}):
        with pytest.raises(PermissionError):
            authority.require(grants, gone, record["record_id"], **{**window, **bad})
    assert authority.tampered(grants, ["vendor", "start", "end", "fields", "authorized_by"]).isEmpty()
    assert authority.tampered(grants.withColumn("vendor", F.lit("w")), ["vendor", "start", "end", "fields", "authorized_by"]).count() == 1
    events = spark.createDataFrame([("p", "registered"), ("p", "authorized"), ("q", "registered")], "protocol string, event string")
    spent = authority.open_once(events, "p", "me", "now")
    with pytest.raises(PermissionError):
        authority.open_once(events.unionByName(spent.select("protocol", "event")), "p", "me", "now")
    with pytest.raises(PermissionError):
        authority.open_once(events, "q", "me", "now")
    assert [r[0] for r in authority.missing_from_ledger(spent, events.limit(0)).collect()] == ["p"]
    with pytest.raises(PermissionError):
        authority.guard_window("2020-01-01", "2021-01-01", after="2020-12-31")


def test_samples_are_deterministic(spark):
    one, two = (named.sample_prices(spark, days=20, assets=5) for _ in range(2))
    assert one.count() == 100 and one.exceptAll(two.repartition(3)).isEmpty()
    assert one.where("low > least(open, close) or high < greatest(open, close)").isEmpty()
    facts = named.sample_fundamentals(one)
    assert facts.count() == 5 * 4 * 4 and facts.where("datediff(filed, period_end) not between 30 and 75").isEmpty()
    with pytest.raises(ValueError):
        named.load(spark, "nothing", "/nowhere")


def test_named_tables_from_a_landing_folder(spark, tmp_path):
    (tmp_path / named.DATASETS["factors5_daily"]).write_text("words\n\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n20200102, 1.00, 0.10,-0.20, 0.00, 0.30, 0.01\n20200103,-99.99, 0.10,-0.20, 0.00, 0.30, 0.01\n\n 2020, 5\n", encoding="latin-1")
    (tmp_path / named.DATASETS["momentum_daily"]).write_text("words\n\n,Mom\n20200102, 0.50\n\nend\n", encoding="latin-1")
    five = named.load(spark, "factors5_daily", str(tmp_path), str(tmp_path / "cache"))
    assert named.five_with_momentum(spark, str(tmp_path)).columns == ["date", "Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF", "Mom"]
    (tmp_path / named.DATASETS["factors_daily"]).write_text("words\n\n,Mkt-RF,SMB,HML,RF\n20200102, 1.00, 0.10,-0.20, 0.01\n", encoding="latin-1")
    assert named.load(spark, "factors_daily", str(tmp_path)).columns == ["date", "Mkt-RF", "SMB", "HML", "RF"]
    (tmp_path / named.DATASETS["factors_monthly"]).write_text("words\n,Mkt-RF,SMB,HML,RF\n202001, 1.00, 0.10,-0.20, 0.01\n\n ,Mkt-RF\n2020, 5\n", encoding="latin-1")
    assert [str(r["date"]) for r in named.load(spark, "factors_monthly", str(tmp_path)).collect()] == ["2020-01-31"]
    (tmp_path / named.DATASETS["industry12_daily"]).write_text("words\n\n,NoDur,Durbl ,Other\n20200102, 1.0, 2.0,-99.99\n", encoding="latin-1")
    industries = named.industry_returns(spark, 12, str(tmp_path)).first()
    assert (industries["NoDur"], industries["Durbl"], industries["Other"]) == (0.01, 0.02, None)
    rows = named.with_momentum(five, named.load(spark, "momentum_daily", str(tmp_path))).collect()
    assert len(rows) == 1 and rows[0]["Mkt-RF"] == pytest.approx(0.01) and rows[0]["Mom"] == pytest.approx(0.005)
    assert named.clear_cache(spark, str(tmp_path / "cache")) == 1


def test_planted_candidates_are_random_and_fat_tails_reach_the_common_part(spark):
    returns, truth = synth.make_return_matrix(spark, n_obs=400, n_candidates=40, n_real=8, rho=0.9, t_df=3, seed=2)
    real = sorted(r["candidate"] for r in truth.where("truth").collect())
    assert len(real) == 8 and real != list(range(8))
    common = returns.groupBy("date").agg(F.avg("ret").alias("x")).agg(F.kurtosis("x")).first()[0]
    assert common > 1.5
    panel, signals = synth.bootstrap_from_real(spark.createDataFrame([(datetime.date(2020, 1, d), a, float(d)) for d in range(1, 21) for a in range(3)], "date date, asset int, ret double"), 4, seed=1)
    assert panel.count() == 60 and signals.count() == 240
    assert panel.groupBy("date").agg(F.count_distinct("ret").alias("n")).where("n > 1").isEmpty()


def test_harmonic_sum(spark):
    rows = spark.createDataFrame([(m,) for m in (0, 1, 2, 99, 100, 101, 5000)], "m bigint").select("m", multiple_testing.harmonic(F.col("m")).alias("h")).collect()
    for r in rows:
        assert r["h"] == pytest.approx(sum(1 / i for i in range(1, max(1, r["m"]) + 1)), rel=1e-13)


def test_split_design_confirms_on_the_rest(spark):
    from panelyard.operators import sharpe
    from panelyard.plans import funnel

    returns, _ = synth.make_family_set(spark, 4, 2, 0.5, 3.0, n_obs=300, seed=5)
    stats, n = funnel.split_statistics(returns, search_end="1990-10-31", stage2_start="1990-06-01", holdout_start="1990-11-01")
    early, _ = funnel.family_statistics(returns.where("date < '1990-06-01'"), search_end="1990-10-31")
    later = sharpe.sharpe_test(returns.where("date >= '1990-06-01' and date <= '1990-10-31'"))
    p2 = {r["candidate"]: r["pvalue_greater"] for r in later.collect()}
    first = {r["family"]: r for r in early.collect()}
    rows = stats.collect()
    assert n == 8 and len(rows) == 4
    for r in rows:
        assert r["best"] == first[r["family"]]["best"] and r["p1_rho"] == pytest.approx(first[r["family"]]["p1_rho"])
        assert r["p2"] == pytest.approx(p2[r["best"]]) and r["ho_n_obs"] > 0
    with pytest.raises(ValueError):
        funnel.split_statistics(returns, search_end="1990-10-31", stage2_start="1989-01-01")
