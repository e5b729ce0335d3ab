"""Plants by arithmetic against planting the returns and running the whole funnel again."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from panelyard.operators import planting
from panelyard.plans import funnel

SEARCH, HELD = "2020-05-31", "2020-06-01"
VOL, PERIODS = 0.01, 252
SCHEMA = "date date, candidate string, family string, pos int, ret double"


@pytest.fixture(scope="module")
def batch(spark):
    """Six families of one to four variants, with gaps, a flat variant, and one family that earns something."""
    r = random.Random(3)
    rows = []
    for f in range(6):
        shared = [r.gauss(0, 0.006) for _ in range(260)]
        for v in range(1 + f % 4):
            for t in range(260):
                date = datetime.date(2019, 11, 1) + datetime.timedelta(days=t)
                ret = None if r.random() < 0.03 else 0.0 if (f, v) == (3, 1) else shared[t] + r.gauss(0.0012 if f == 2 else 0.0, 0.008)
                rows.append((date, f"c{f}{v}", f"f{f}", v, ret))
    return spark.createDataFrame(rows, SCHEMA).persist()


def again(batch, target, ratio, th):
    """The funnel over returns with the plant in them."""
    moved = batch.withColumn("ret", F.when(F.col("family") == target, F.col("ret") + ratio / math.sqrt(PERIODS) * VOL).otherwise(F.col("ret")))
    stats, n = funnel.family_statistics(moved, search_end=SEARCH, holdout_start=HELD, periods=PERIODS)
    return {r["family"]: r for r in funnel.run_funnel(stats, th, n, periods=PERIODS).collect()}


def test_a_plant_equals_the_funnel_run_again(batch):
    """Statistics of the target, and its way through the stages, for the robust variance and the correlation-adjusted p."""
    th = funnel.Thresholds(q1=0.3, alpha2=0.4, q4=0.4)
    side = planting.null_side(batch, search_end=SEARCH, holdout_start=HELD)
    grid = [0.0, 6.0]
    stats = {(r["target"], r["sharpe"]): r for r in planting.planted(side, ["f1", "f3"], grid).collect()}
    decided = {(r["target"], r["sharpe"]): r for r in planting.decisions(side, th, ["f1", "f3"], grid).collect()}
    assert set(stats) == set(decided) == {(t, s) for t in ("f1", "f3") for s in grid}
    for (target, ratio), r in stats.items():
        whole = again(batch, target, ratio, th)[target]
        for mine, its in (("p1", "p1_rho"), ("p2", "p2"), ("ho_p", "ho_p"), ("ho_sharpe", "ho_sharpe"), ("ho_variance", "ho_variance")):
            assert r[mine] == pytest.approx(whole[its], rel=1e-7, abs=1e-12), (target, ratio, mine)
        assert r["best"] == whole["best"] and r["ho_n_obs"] == whole["ho_n_obs"]
        d = decided[target, ratio]
        assert (d["stage1"], d["accepted"]) == (whole["stage1"], whole["stage4"])
        assert d["stage2"] == (whole["p2"] <= th.alpha2) and d["accepted"] <= d["stage4"]
    assert decided["f1", 6.0]["accepted"]


def plain_worlds(null, fresh, th):
    """One family at a time among all others, by sorting each world."""

    def step_up(ps, q):
        order = sorted(ps, key=lambda f: ps[f])
        cut = max((i for i, f in enumerate(order, 1) if ps[f] <= q * i / len(ps)), default=0)
        return set(order[:cut])

    out = {}
    for (target, ratio), mine in fresh.items():
        world = {f: r for f, r in null.items() if f != target} | {target: mine}
        first = step_up({f: r["p1"] for f, r in world.items()}, th.q1)
        alive = {f for f in first if world[f]["p2"] <= th.alpha2} | {target}
        last = step_up({f: 1.0 if world[f]["ho_p"] is None else world[f]["ho_p"] for f in alive}, th.q4)
        out[target, ratio] = (target in first, mine["p2"] <= th.alpha2, target in last)
    return out


@pytest.mark.parametrize(("q1", "alpha2", "q4"), [(0.5, 1.0, 0.5), (0.05, 0.2, 0.1), (0.9, 0.9, 0.9)])
def test_decisions_equal_whole_worlds(batch, q1, alpha2, q4):
    """Families left out as out of reach change nothing."""
    th = funnel.Thresholds(q1=q1, stage1="independent", alpha2=alpha2, q4=q4)
    side = planting.null_side(batch, search_end=SEARCH, holdout_start=HELD, stage1="independent", method="normal")
    grid = [0.0, 1.0, 2.0, 4.0, 8.0]
    null = {r["family"]: r for r in side.null.collect()}
    fresh = {(r["target"], r["sharpe"]): r for r in planting.planted(side, None, grid).collect()}
    assert len(fresh) == 30
    got = {(r["target"], r["sharpe"]): (r["stage1"], r["stage2"], r["stage4"]) for r in planting.decisions(side, th, None, grid).collect()}
    assert got == plain_worlds(null, fresh, th)
    shares = {s: sum(v[1] for (_, x), v in got.items() if x == s) / 6 for s in grid}
    at = {r["stage"]: r["at"] for r in planting.detectable(planting.decisions(side, th, None, grid), 0.5).collect()}["stage2"]
    assert at is None or shares[min(s for s in grid if s >= at)] >= 0.5


def test_deflated_final_gate_and_refusals(batch):
    side = planting.null_side(batch, search_end=SEARCH, holdout_start=HELD, stage1="independent")
    for trials in ("survivors", "searched"):
        th = funnel.Thresholds(q1=0.3, stage1="independent", final="dsr", final_trials=trials)
        rows = planting.decisions(side, th, ["f2"], [0.0, 40.0]).orderBy("sharpe").collect()
        assert rows[-1]["accepted"]
    for targets, grid in ((["f1", "f1"], [1.0]), (["nope"], [1.0]), (["f1"], [1.0, 1.0]), (["f1"], [-1.0]), (["f1"], [])):
        with pytest.raises(ValueError):
            planting.planted(side, targets, grid)
    both = planting.planted_sides(side, ["f1", "f2"], [0.0, 3.0])
    assert both.count() == 12
    null = {r["family"]: r["p1"] for r in side.null.collect()}
    assert all(r["p1"] == pytest.approx(null[r["family"]]) for r in both.where("sharpe = 0 or family not in ('f1', 'f2')").collect())


def test_correlations_with_and_without_gaps(spark, batch):
    """Sums over dates give what pairs give, and gaps are correlated on common dates."""
    import numpy as np

    def plain(rows):
        frame = {}
        for r in rows:
            frame.setdefault((r["family"], r["candidate"]), {})[r["date"]] = r["ret"]
        names, inside, across = sorted(frame), {}, []
        for i, a in enumerate(names):
            for b in names[:i]:
                days = [d for d in frame[a] if frame[a][d] is not None and frame[b].get(d) is not None]
                x, y = np.array([frame[a][d] for d in days]), np.array([frame[b][d] for d in days])
                if x.std() and y.std():
                    c = np.corrcoef(x, y)[0, 1]
                    inside.setdefault(a[0], []).append(c) if a[0] == b[0] else across.append(c)
        return float(np.mean([np.mean(v) for v in inside.values()])), float(np.mean(across))

    full = batch.where("date not in (select date from values (date'2019-11-01') t(date))").withColumn("ret", F.coalesce("ret", F.lit(0.001)))
    for rows in (batch, full):
        got = planting.correlations(rows).first()
        assert (got["within"], got["across"]) == pytest.approx(plain(rows.collect()))
    s = planting.structure(full, search_end=SEARCH, holdout_periods=40, n_trials=9)
    assert s.variants == (1, 2, 3, 4, 1, 2) and 0 <= s.across_corr <= s.within_corr <= 1 and s.search_periods == full.where(f"date <= '{SEARCH}'").select("date").distinct().count()
