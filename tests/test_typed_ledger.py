"""Typed JSON, and corrections that name runs by it, against the sequential reading of a ledger."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from panelyard.functions import typed_json as tj
from panelyard.operators import ledger

FIX = ledger.CORRECTION
VALUES = [1, 1.0, True, False, 0, "1", None, [1], [1.0], [1, "x"], [1.0, "x"], {"a": 1, "b": [2.5]}, {"b": [2.5], "a": 1}, {"a": 1.0, "b": [2.5]}, 100.0, 1e2, 100, "", "1.5", 'a "b": 1.0, c', {"k": {"x": 1e-3}}, {"k": {"x": 0.001}}, -2.0, -2, [], {}]


def test_equal_as_json_values(spark):
    rows = [(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(100, '{"a": 1e2 , "b":[ 2.50 ]}'), (101, '{"b":[2.5],"a":100.0}'), (102, "not json"), (103, None), (104, "1.0 trailing")]
    df = spark.createDataFrame(rows, "i int, s string")
    got = {(r["i"], r["j"]) for r in df.alias("a").crossJoin(df.select(F.col("i").alias("j"), F.col("s").alias("t"))).where(tj.same(F.col("s"), F.col("t"))).collect()}
    plain = lambda v: json.dumps(v, sort_keys=True)
    known = {i: plain(json.loads(s)) for i, s in rows if i < 102}
    assert got == {(i, j) for i in known for j in known if known[i] == known[j]}


def frame(spark, entries):
    rows = [(i, e["ts_utc"], "u", "g", e["name"], 0, json.dumps(e.get("params")) if "params" in e else None, json.dumps(e["metrics"]) if "metrics" in e else None, e.get("tags"), None) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "line bigint, " + ledger.SCHEMA)


def run(ts, **params):
    return {"ts_utc": ts, "name": "run", "params": params}


def fix(ts, **params):
    return {"ts_utc": ts, "name": FIX, "params": {"reason": "because"} | params}


def both(spark, entries, **scope):
    trials, gone, _ = ledger.corrected(enumerate(entries, 1))
    df = frame(spark, entries)
    assert ledger.trial_count(df, **scope).first()["trials"] == len(trials)
    assert ledger.excluded_runs(df).count() == len(gone)
    return len(trials)


def test_params_match_as_the_same_json_value(spark):
    entries = [run("t1", f=1), run("t1", f=True), run("t1", f=1.0), run("t1", f="1", g=2), fix("t2", ledger_name="run", excludes=[{"ts_utc": "t1", "f": True}])]
    assert both(spark, entries) == 3
    assert both(spark, [*entries, fix("t3", ledger_name="run", excludes=[{"ts_utc": "t1", "f": "1", "g": 2}, {"ts_utc": "t1", "f": 1}, {"ts_utc": "t1", "f": 1}])]) == 1
    assert both(spark, [*entries[:4], fix("t0", ledger_name="other", excludes=[{"ts_utc": "t1"}])]) == 4


def test_repeated_lines_order_metrics_and_retractions(spark):
    twice = fix("t2", ledger_name="run", excludes=[{"ts_utc": "t1"}])
    assert both(spark, [run("t1", a=1), run("t1", a=2), twice, twice]) == 1, "a copy of the line takes no second run"
    assert both(spark, [twice, run("t1", a=1)]) == 1, "only runs before the correction"
    assert both(spark, [run("t1") | {"metrics": {"sharpe": 1}}, run("t1"), fix("t2", ledger_name="run", excludes=[{"ts_utc": "t1"}, {"ts_utc": "t1"}])]) == 1, "a seen run stays a trial"
    chain = [run("t1"), twice, fix("t3", retracts=["t2"]), fix("t4", retracts=["t3"]), fix("t5", retracts=["t4"]), fix("t6", retracts=["t5"])]
    assert [both(spark, chain[:n]) for n in range(2, 7)] == [0, 1, 0, 1, 0]
    assert both(spark, []) == 0


def test_made_up_ledgers(spark):
    for seed in range(4):
        r = random.Random(seed)
        entries, fixes = [], []
        for i in range(60):
            if r.random() < 0.6 or i < 10:
                entries.append(run(f"t{r.randrange(8)}", f=r.choice([1, 1.0, True, "1"]), g=r.randrange(2)) | ({"metrics": {"x": 1}} if r.random() < 0.2 else {}))
            elif fixes and r.random() < 0.4:
                entries.append(fix(f"c{i}", retracts=r.sample(fixes, 1)))
                fixes.append(f"c{i}")
            else:
                item = lambda: {"ts_utc": f"t{r.randrange(8)}"} | r.choice([{}, {"f": r.choice([1, 1.0, True])}, {"g": r.randrange(2)}])  # noqa: B023, E731
                entries.append(fix(f"c{i}", ledger_name="run", excludes=[item() for _ in range(r.randrange(1, 4))]))
                fixes.append(f"c{i}")
        both(spark, entries)


def test_entries_for_a_configuration_and_rows_as_json(spark):
    df = frame(spark, [run("t1", config_hash="abc", x=1.0), run("t2", config_hash="abd"), run("t3", config_hash=5), run("t4"), run("t5", config_hash="abc")])
    assert [r["ts_utc"] for r in ledger.entries_for(df, "run", "abc").collect()] == ["t1", "t5"] and ledger.entries_for(df, "run", "5").count() == 0
    got = [json.loads(r["json"]) for r in ledger.as_json(df.select("line", "ts_utc", "params", "metrics", "tags")).collect()]
    assert got[0] == {"line": 0, "ts_utc": "t1", "params": {"config_hash": "abc", "x": 1.0}, "metrics": None, "tags": None} and len(got) == 5
