from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import backtest, ledger, market_data, monitor, search, sharpe, spanning, validation
from panelyard.operators import multiple_testing as mt
from panelyard.sources import databases, files

DAY = dt.date


def test_missing_returns_by_rule(spark):
    rows = [
        (1, DAY(2020, 1, 2), None, "NS", "N", None, 0.0), (1, DAY(2020, 1, 3), None, "MP", "N", None, 0.0), (1, DAY(2020, 1, 6), 0.05, "NA", "N", None, 0.05), (11786, DAY(2023, 3, 13), None, "DG", "Y", "GDR", -1.0),
        (7, DAY(2001, 1, 2), None, "DG", "Y", "GDR", -0.5), (8, DAY(2005, 1, 3), None, "DM", "Y", "MER", None), (9, DAY(2003, 3, 18), -0.01, "NA", "N", None, -0.01), (9, DAY(2003, 3, 19), None, "NT", "N", None, -0.5), (9, DAY(2003, 3, 20), None, "NT", "N", None, None),
    ]
    df = spark.createDataFrame(rows, "permno int, date date, dlyret double, dlyretmissflg string, dlydelflg string, delactiontype string, expected double")
    assert all(r["ret"] == r["expected"] for r in market_data.daily_returns(df).collect())


def test_availability_is_strictly_later(spark):
    days = spark.createDataFrame([(DAY(2020, 4, d),) for d in (1, 2, 3, 6)], "date date")
    facts = spark.createDataFrame([(1, DAY(2020, 3, 31), DAY(2020, 4, 2)), (2, DAY(2020, 1, 2), None), (3, DAY(2020, 3, 31), DAY(2020, 4, 6)), (4, DAY(2020, 1, 1), DAY(2020, 2, 1)), (5, None, None)], "id int, datadate date, rdq date")
    got = {r["id"]: r["available"] for r in market_data.available_from(facts, days).collect()}
    assert got == {1: DAY(2020, 4, 3), 2: DAY(2020, 4, 2), 3: None, 4: DAY(2020, 4, 1), 5: None}


def test_hac_variance_against_plain_numpy(spark):
    x = np.random.default_rng(3).normal(0.01, 0.05, 90)
    x[1:] += 0.3 * x[:-1]
    rows = [("a", DAY(2020, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)] + [("a", DAY(2019, 1, 1), None), ("flat", DAY(2020, 1, 1), 0.1), ("flat", DAY(2020, 1, 2), 0.1)]
    df = spark.createDataFrame(rows, "candidate string, date date, ret double")
    got = {r["candidate"]: r for r in sharpe.sharpe_test(df).collect()}
    d = x - x.mean()
    m = np.column_stack([d, d * d - (d * d).mean()])
    omega = m.T @ m / len(x)
    lags = sharpe.newey_west_lags(len(x))
    for j in range(1, lags + 1):
        g = m[j:].T @ m[:-j] / len(x)
        omega += (1 - j / (lags + 1)) * (g + g.T)
    grad = np.array([1 / d.std(), -x.mean() / (2 * d.std() ** 3)])
    assert got["a"]["variance"] == pytest.approx(grad @ omega @ grad)
    assert got["a"]["psr"] == pytest.approx(1 - got["a"]["pvalue_greater"])
    assert got["flat"]["sharpe"] is None and got["flat"]["variance"] is None


def test_corrections_hold_their_order(spark):
    p = [0.001, 0.008, 0.02, 0.03, 0.2, None, 0.6]
    df = spark.createDataFrame(list(enumerate(p)), "candidate int, p double")
    count = lambda f: f(df, 0.05).where("rejected").count()
    assert count(mt.bonferroni) <= count(mt.holm) <= count(mt.benjamini_hochberg)
    assert (count(mt.bonferroni), count(mt.benjamini_hochberg)) == (1, 4)
    q = {r["candidate"]: (r["q"], r["bh"]) for r in mt.bh_adjusted(mt.storey_qvalues(df, 0.0)).collect()}
    assert all(a == pytest.approx(b) for a, b in q.values() if a is not None) and q[5] == (None, None)


def test_band_keeps_small_moves_and_hold_carries(spark):
    rows = [("c", DAY(2020, 1, d), a, s, 0.0) for d, pair in enumerate([(1.0, -1.0), (1.1, -1.1), (-1.0, 1.0), (None, None), (None, None)], 1) for a, s in zip("xy", pair, strict=True)]
    df = spark.createDataFrame(rows, "candidate string, date date, asset string, signal double, ret double")
    got = backtest.backtest(df, cost_bps=10.0).orderBy("date").collect()
    assert [r["turnover"] for r in got] == [None, pytest.approx(1.0), pytest.approx(0.0), pytest.approx(2.0), pytest.approx(1.0)]
    assert got[3]["cost"] == pytest.approx(0.002) and got[3]["net"] == pytest.approx(-0.002)
    banded = backtest.positions(df, band=2.5).orderBy("date", "asset").collect()
    assert [r["weight"] for r in banded][:6] == [0.5, -0.5] * 3


def test_ledger_corrections_and_retractions(tmp_path, spark):
    path = str(tmp_path / "ledger.jsonl")
    for i, (name, params, metrics) in enumerate([("run", {"f": 1}, {}), ("run", {"f": 2}, {}), ("run", {"f": 3}, {"s": 1}), (ledger.CORRECTION, {"ledger_name": "run", "reason": "twice", "excludes": [{"ts_utc": "t1"}, {"ts_utc": "t2"}, {"ts_utc": "t9"}]}, {}), (ledger.CORRECTION, {"ledger_name": "run", "reason": "x", "excludes": [{"ts_utc": "t0"}]}, {}), (ledger.CORRECTION, {"reason": "wrong", "retracts": ["t4"]}, {})]):
        ledger.append(path, {"name": name, "ts_utc": f"t{i}", "params": params, "metrics": metrics, "tags": []})
    entries = [json.loads(line) for line in open(path)]
    trials, excluded, unmatched = ledger.corrected(enumerate(entries))
    assert [e["ts_utc"] for e in trials] == ["t0", "t2"] and [e["ts_utc"] for e in excluded] == ["t1", "t2"] and unmatched == 1
    assert ledger.trial_count(ledger.read(spark, path), name="run").first()["trials"] == 2


def test_monitor_batch_matches_one_at_a_time(spark):
    config = monitor.MonitorConfig(0.1, 1.0, horizon=30)
    r = np.random.default_rng(1).normal(-0.5, 1, 40).tolist()
    r[5] = None
    got = monitor.e_process(spark.createDataFrame([("s", i, v) for i, v in enumerate(r)], "strategy string, t int, r double"), config).orderBy("t").collect()
    wealth = [0.0] * len(config.bets)
    for row in got:
        wealth = [w + s for w, s in zip(wealth, config.steps(row["r"]), strict=True)]
        assert row["e_value"] == pytest.approx(config.e_value(wealth))


def test_stream_matches_batch(spark, tmp_path):
    from panelyard.streaming.monitor import monitor_stream

    config = monitor.MonitorConfig(0.5, 1.0, horizon=10)
    rows = [(s, t, float(v)) for s in ("a", "b") for t, v in enumerate(np.random.default_rng(ord(s)).normal(0, 1, 15))]
    df = spark.createDataFrame(rows, "strategy string, t bigint, r double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = monitor_stream(stream, config).writeStream.format("memory").queryName("monitored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    last = {r["strategy"]: r["decision"] for r in spark.sql("select strategy, max_by(decision, t) as decision from monitored group by strategy").collect()}
    assert last == {r["strategy"]: r["decision"] for r in monitor.decisions(df, config).collect()}


def test_search_adjustment():
    assert search.adjusted_pvalue(0.01, 20) == pytest.approx(1 - 0.99**20)
    assert search.adjusted_pvalue(0.01, 20, 1e-6) == pytest.approx(1 - 0.99**20, rel=1e-3)
    assert 0.01 < search.adjusted_pvalue(0.01, 20, 0.9) < 0.06 and search.adjusted_pvalue(0.01, 20, 1.0) == 0.01
    e = sharpe.familywise_errors(0.05, 0.2, 0.9, 3)
    assert e["beta_k"] == pytest.approx(((0.9 * 0.95 + 0.1 * 0.2) ** 3 - (0.9 * 0.95) ** 3) / (1 - 0.9**3))


def test_spanning_recovers_an_intercept(spark):
    rng = np.random.default_rng(5)
    f = rng.normal(0, 0.01, (400, 2))
    y = 0.001 + f @ [0.5, -0.3] + rng.normal(0, 0.002, 400)
    days = [DAY(2020, 1, 1) + dt.timedelta(i) for i in range(400)]
    factors = spark.createDataFrame([(d, 0.0, float(a), float(b)) for d, (a, b) in zip(days, f, strict=True)], "date date, RF double, A double, B double")
    returns = spark.createDataFrame([("c", d, float(v)) for d, v in zip(days, y, strict=True)] + [("dead", d, 0.0) for d in days], "candidate string, date date, ret double")
    got = {r["candidate"]: r for r in spanning.factor_alpha(returns, factors, returns_are_excess=True, names=("A", "B")).collect()}
    assert got["c"]["alpha"] == pytest.approx(0.001, abs=3e-4) and got["c"]["pvalue"] < 1e-6 and got["dead"]["alpha"] is None


def test_purged_folds_leave_no_overlap(spark):
    dates = spark.createDataFrame([(DAY(2020, 1, 1) + dt.timedelta(i),) for i in range(40)], "date date")
    rows = validation.purged_kfold(dates, 4, 3, embargo_pct=0.1).collect()
    for fold in range(4):
        test = [r["date"] for r in rows if r["fold"] == fold and r["role"] == "test"]
        train = [r["date"] for r in rows if r["fold"] == fold and r["role"] == "train"]
        assert test and all(t + dt.timedelta(3) <= min(test) or t >= max(test) + dt.timedelta(3 + 4) for t in train)


def test_files_and_records(spark, tmp_path):
    text = "prose\n\n,Mkt-RF,SMB\n19900102,  1.50, -0.20\n19900103,-99.99,  0.10\n\n Annual\n1990, 5, 6\n"
    rows = files.factor_table(spark.createDataFrame([(text,)], "value string"), ["Mkt-RF", "SMB"]).orderBy("date").collect()
    assert [(r["date"], r["Mkt-RF"], r["SMB"]) for r in rows] == [(DAY(1990, 1, 2), pytest.approx(0.015), pytest.approx(-0.002)), (DAY(1990, 1, 3), None, pytest.approx(0.001))]
    assert databases.pgpass_fields(r"host:5432:d\:b:me:p\\w") == ["host", "5432", "d:b", "me", "p\\w"]
    assert files.manifest_version({"b": "2", "a": "1"}) == files.manifest_version({"a": "1", "b": "2"})
    with pytest.raises(PermissionError):
        files.guard(None, "2020-12-31", protected=True)
    df = spark.createDataFrame([(DAY(2020, 1, 1), [DAY(2020, 1, 1)])], "d date, l array<date>")
    with pytest.raises(ValueError, match="repeated"):
        files.bounded(df, "2021-01-01")
    assert files.bounded(df.select("d"), "2020-01-01").count() == 0
    work = json.dumps({"id": "W1", "doi": "https://doi.org/10.1/X", "title": "A B", "abstract_inverted_index": {"hello": [0], "world": [1]}, "authorships": [{"author": {"display_name": "N"}, "institutions": [{"display_name": "I", "country_code": "GB"}]}]})
    r = databases.works(spark.createDataFrame([(work,)], "value string")).first()
    assert (r["doi"], r["abstract"], r["authors"], r["countries"]) == ("10.1/x", "hello world", ["N"], ["GB"])
