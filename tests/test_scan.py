"""Ranks, running extrema and corrections over sorted ranges, against plain code."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import multiple_testing as mt
from panelyard.operators import scan


def pvalues(seed, n):
    r = random.Random(seed)
    return [r.choice([r.random() ** 3, round(r.random(), 1), 1.0, 0.0, None]) if r.random() < 0.5 else r.random() ** 4 for _ in range(n)]


def plain(ps, lam, pfdr):
    """Adjusted values by their definitions, from the smallest p up."""
    m, there = len(ps), sorted(x for x in ps if x is not None)
    n = len(there)
    h = math.fsum(1 / i for i in range(1, m + 1))
    pi0 = 1.0 if lam == 0 else min(1.0, sum(x > lam for x in there) / ((1 - lam) * n)) if n else None

    def storey(x):
        count = sum(y <= x for y in there)
        some = 1 - (1 - x) ** n
        return pi0 / count if pfdr and some == 0 else pi0 * x * n / count / (some if pfdr else 1)

    def of(x):
        if x is None:
            return (None,) * 4
        first = there.index(x)
        last = n - 1 - there[::-1].index(x)
        return (
            min(1, max((m - i) * there[i] for i in range(last + 1) if i <= last)) if first == last else None,
            min(1, min(there[i] * m * h / (i + 1) for i in range(first, n))), min(1, min(there[i] * n / (i + 1) for i in range(first, n))), min(1, min(storey(there[i]) for i in range(first, n))),
        )

    return [of(x) for x in ps]


def close(a, b):
    return (a is None and b is None) or a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize(("seed", "n", "lam", "pfdr"), [(1, 300, 0.5, False), (2, 57, 0.0, True), (3, 1, 0.5, False), (4, 200, 0.8, True)])
def test_adjusted_values(spark, seed, n, lam, pfdr):
    ps = pvalues(seed, n)
    expected = plain(ps, lam, pfdr)
    rows = spark.createDataFrame(list(enumerate(ps)), "candidate int, p double")
    out = {r["candidate"]: r for r in mt.storey_qvalues(mt.evidence_profile(rows, lam=lam), lam, pfdr=pfdr, name="q2").collect()}
    assert len(out) == n
    for i, (holm, by, bh, q) in enumerate(expected):
        r = out[i]
        assert close(r["by"], by) and close(r["bh"], bh) and close(r["q2"], q), (i, ps[i])
        assert holm is None or close(r["holm"], holm)
        assert pfdr or close(r["q"], q)


def test_families_apart_and_missing(spark):
    """Each family is corrected by itself, null being one; a family of missing p-values has none rejected."""
    rows = [(f, p) for f, seed in (("a", 5), ("b", 6), (None, 7)) for p in pvalues(seed, 80)] + [("c", None)] * 3
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, family string, p double")
    for f in (mt.holm, mt.benjamini_hochberg, mt.benjamini_yekutieli, mt.bonferroni):
        whole = {r["id"]: r["rejected"] for r in f(df, 0.2, by=["family"]).collect()}
        assert len(whole) == len(rows)
        for family in ("a", "b", None, "c"):
            alone = f(df.where(F.col("family").eqNullSafe(family)), 0.2).collect()
            assert all(whole[r["id"]] == r["rejected"] for r in alone)
        assert not any(whole[i] for i, (g, _) in enumerate(rows) if g == "c")


def test_step_up_is_the_adjusted_value_at_a_level(spark):
    df = spark.createDataFrame(list(enumerate(pvalues(9, 150))), "candidate int, p double")
    adjusted = {r["candidate"]: r for r in mt.evidence_profile(df).collect()}
    for f, column in ((mt.benjamini_hochberg, "bh"), (mt.benjamini_yekutieli, "by"), (mt.holm, "holm")):
        for r in f(df, 0.1).collect():
            value = adjusted[r["candidate"]][column]
            assert r["rejected"] == (value is not None and value <= 0.1)


def test_ranks_and_running_extrema(spark):
    r = random.Random(1)
    rows = [(r.choice("xyz"), r.randrange(12), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = scan.running(scan.running(scan.ranked(df, F.col("v"), by=["g"]), F.col("i"), "top", by=["g"]), F.col("i"), "least", by=["g"], largest=False, from_end=True).collect()
    for g in "xyz":
        mine = sorted((x for x in got if x["g"] == g), key=lambda x: x["_r"])
        assert [x["_r"] for x in mine] == list(range(1, len(mine) + 1))
        assert [x["v"] for x in mine] == sorted(x["v"] for x in mine)
        ids = [x["i"] for x in mine]
        assert [x["top"] for x in mine] == [max(ids[: k + 1]) for k in range(len(ids))]
        assert [x["least"] for x in mine] == [min(ids[k:]) for k in range(len(ids))]
    assert scan.ranked(df.limit(0), F.col("v")).count() == 0


def test_no_task_sees_all_rows(spark):
    """Windows without a partition stand over one row a range only."""
    df = spark.createDataFrame(list(enumerate(pvalues(2, 400))), "candidate int, p double")
    plan = mt.evidence_profile(df)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.split("\n") if "Window" in line]
    assert lines and all("_part" in line for line in lines)


def test_bootstrap_lambda(spark):
    """Drawn counts have the law of resampled p-values: mean squares agree with a plain bootstrap within its noise."""
    r = np.random.default_rng(8)
    ps = np.concatenate([r.random(700), r.random(300) ** 8])
    df = spark.createDataFrame([(float(x),) for x in ps], "p double")

    def rate(x, lam):
        pi0 = 1.0 if lam == 0 else (x > lam).sum() / ((1 - lam) * len(x))
        return min(1.0, pi0 * 0.05 / (max((x <= 0.05).sum(), 1) / len(x) * (1 - 0.95 ** len(x))))

    grid = {row["lam"]: row["pfdr"] for row in mt.pfdr_grid(df).collect()}
    assert grid == {lam: pytest.approx(rate(ps, lam)) for lam in mt.GRID}
    target = min(rate(ps, lam) for lam in mt.GRID)
    draws = [ps[r.integers(0, len(ps), len(ps))] for _ in range(400)]
    mse = {lam: np.mean([(rate(d, lam) - target) ** 2 for d in draws]) for lam in mt.GRID}
    chosen = mt.bootstrap_lambda(df, n_boot=400)
    assert mse[chosen] <= 1.35 * min(mse.values())
    assert mt.bootstrap_lambda(df, n_boot=400) == chosen
    assert mt.estimate_pi0(df, None, n_boot=400).first()["pi0"] == pytest.approx(mt.estimate_pi0(df, chosen).first()["pi0"])
    q = mt.storey_qvalues(df, None).agg(F.max("q")).first()[0]
    assert 0 < q <= 1
    with pytest.raises(ValueError):
        mt.bootstrap_lambda(df.limit(0))


def test_shares_of_the_bins(spark):
    """All p-values in few bins, one of them at the ends."""
    df = spark.createDataFrame([(0.0,), (0.05,), (1.0,), (0.95,), (None,)], "p double")
    assert mt.bootstrap_lambda(df, n_boot=50) in mt.GRID
    assert Counter(r["m"] for r in [mt.estimate_pi0(df, 0.5).first()]) == {4: 1}
