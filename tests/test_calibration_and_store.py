from __future__ import annotations

import numpy as np
import pytest

from panelyard.functions import normal
from panelyard.operators import calibration, local_fdr
from panelyard.operators.store import Store


def test_local_fdr_finds_what_stands_out(spark):
    rng = np.random.default_rng(7)
    z = np.concatenate([rng.normal(0.4, 0.8, 380), rng.normal(5, 0.5, 20)])
    df = spark.createDataFrame([(i, normal.sf(float(v))) for i, v in enumerate(z)] + [(999, None)], "candidate int, p double")
    got = {r["candidate"]: r["lfdr"] for r in local_fdr.local_fdr(df).collect()}
    assert sum(got[i] <= 0.2 for i in range(380, 400)) >= 17 and sum(got[i] <= 0.2 for i in range(380)) <= 4 and got[999] is None
    null = local_fdr.empirical_null(local_fdr.z_scores(df))
    assert null.delta == pytest.approx(0.4, abs=0.25) and null.sigma == pytest.approx(0.8, abs=0.25)
    with pytest.raises(ValueError, match="needs"):
        local_fdr.empirical_null(local_fdr.z_scores(df.limit(50)))


def test_settings_are_ranked(spark):
    rows = [("a", 0, 0.0, 1, 0, 1), ("a", 0, 0.0, 0, 0, 0), ("a", 2, 1.0, 2, 2, 0), ("b", 0, 0.0, 0, 0, 0), ("b", 2, 1.0, 1, 1, 0)]
    got = {r["rule"]: r for r in calibration.summarise(spark.createDataFrame(rows, "rule string, n_real int, sharpe double, discoveries int, true int, false int"), 0.1, 0.0).collect()}
    assert got["a"]["worst_fdr"] == 0.5 and not got["a"]["safe"] and got["b"]["safe"] and got["a"]["null_any_false"] == 0.5 and got["b"]["mean_power"] == 0.5
    curve = spark.createDataFrame([(0.0, 0.1), (1.0, 0.3), (2.0, 0.2), (3.0, 0.9)], "sharpe double, power double")
    assert calibration.crossing(curve, 0.6).first()["at"] == pytest.approx(2.5) and calibration.crossing(curve, 0.95).first()["at"] is None
    assert calibration.threshold_grid(spark, q1=[0.1, 0.2], final=["bh", "dsr"]).count() == 4


def test_store_keeps_every_proposal(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.append("papers", [{"key": "p", "title": "T"}, {"key": "p", "title": "T"}], once="key") == 1
    h = store.add_hypothesis("p", "market", "prices revert")
    assert store.add_hypothesis("p", "market", "prices revert") == h and store.table("hypotheses").count() == 1
    a, new = store.add_factor("rank(close) + open", h)
    b, again = store.add_factor("open + rank(close)", h)
    store.reject(h, "nonsense(", "doesn't parse")
    assert a == b and new and not again and store.table("factors").count() == 1
    assert [r["status"] for r in store.lineage(a).collect()] == ["accepted", "duplicate"]
    assert {(r["group"], r["n"]) for r in store.stats().collect()} == {("accepted", 1), ("duplicate", 1), ("rejected", 1), ("market", 1)}
    assert store.nearest("rank(close) * volume").first()["nodes"] == 2
