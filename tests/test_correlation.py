"""Mean correlations without pairs, against pairs by themselves."""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
import pytest

from panelyard.operators import correlation, planting


def gappy(k, dates, seed):
    """Series of which some have all dates, some lack one of few, some lack any, and some are flat in part."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(k, dates)) + r.normal(size=dates)
    for i in range(k):
        if i % 3 == 1:
            x[i, i % 4] = np.nan
        elif i % 11 == 2:
            x[i, r.random(dates) < 0.5] = np.nan
        elif i % 31 == 3:
            x[i, 2:] = 0.5
    return x, r.integers(0, 5, k)


def plain(x, family):
    """(sum, pairs) of all and of each family, pair by pair."""
    out = {}
    for i in range(len(x)):
        for j in range(i):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            p, q = x[i, both], x[j, both]
            if both.sum() > 1 and np.ptp(p) and np.ptp(q):
                c = np.corrcoef(p, q)[0, 1]
                for key in [None] + [int(family[i])] * bool(family[i] == family[j]):
                    s, n = out.get(key, (0.0, 0))
                    out[key] = s + c, n + 1
    return out


def rows(spark, x, family):
    day = [datetime.date(2020, 1, 1) + datetime.timedelta(days=t) for t in range(x.shape[1])]
    i, t = np.nonzero(~np.isnan(x))
    return spark.createDataFrame(pa.table({"date": [day[u] for u in t], "candidate": pa.array(i, pa.int64()), "family": pa.array(family[i].astype(np.int32)), "ret": x[i, t]}))


def test_classes_blocks_and_tiles_against_pairs(monkeypatch):
    x, family = gappy(160, 9, 1)
    live = np.nanmax(x, 1) > np.nanmin(x, 1)
    x, family = x[live], family[live]
    monkeypatch.setattr(correlation, "CLASS", 8)
    monkeypatch.setattr(correlation, "BLOCK", 16)
    expected = plain(x, family)

    def tile(part):
        has = [np.flatnonzero(~np.isnan(s)).astype(np.int32) for s in x[part]]
        return correlation.Tile(pa.table({"at": pa.chunked_array([pa.array(has)]), "x": pa.chunked_array([pa.array([s[h] for s, h in zip(x[part], has, strict=True)])])}), x.shape[1], family[part])

    totals = correlation.Totals(5)
    a, b = tile(slice(0, 70)), tile(slice(70, None))
    assert a.classes and len(a.x)
    for left, right in ((a, None), (b, None), (a, b)):
        correlation._crossed(left, right, totals)
    assert totals.pairs == expected[None][1] and totals.all == pytest.approx(expected[None][0])
    for f in range(5):
        assert totals.counts[f] == expected[f][1] and totals.sums[f] == pytest.approx(expected[f][0])


def test_many_series_make_no_row_a_pair(spark):
    """700 series with gaps go through two tiles; no operator gives more rows than the panel times the tiles."""
    x, family = gappy(700, 12, 2)
    given = rows(spark, x, family)
    expected = plain(x, family)
    got = {r["family"]: (r["s"], r["n"]) for r in correlation.correlation_sums(given).collect()}
    apart = {r["family"]: (r["s"], r["n"]) for r in correlation.correlation_sums(given, across=False).collect()}
    assert set(got) == set(expected) and set(apart) == set(expected) - {None}
    for f, (s, n) in expected.items():
        assert got[f] == (pytest.approx(s), n)
        assert f is None or apart[f] == (pytest.approx(s), n)
    found = planting.correlations(given)
    means = [expected[f][0] / expected[f][1] for f in range(5)]
    s, n = expected[None][0] - sum(expected[f][0] for f in range(5)), expected[None][1] - sum(expected[f][1] for f in range(5))
    assert tuple(found.first()) == (pytest.approx(np.mean(means)), pytest.approx(s / n))
    assert "Join [date" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_family_correlation_makes_no_row_a_pair(spark):
    """A family's rho comes from sums of its variants, and no join on dates pairs them."""
    from panelyard.plans import funnel

    x, family = gappy(60, 12, 3)
    given = rows(spark, x, family)
    found = funnel._within_family_correlation(given.select("date", "candidate", "ret"), given.select("candidate", "family").distinct())
    assert "covar_pop" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = plain(x, family)
    assert {r["family"]: r["rho"] for r in found.collect()} == {f: pytest.approx(s / n) for f, (s, n) in expected.items() if f is not None}
