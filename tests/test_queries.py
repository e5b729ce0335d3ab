from __future__ import annotations

import datetime
import os
from decimal import Decimal

import pytest

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Rows as sorted texts: a number by its value, whatever its type, and a date or time by its day."""
    text = lambda v: "~" if v is None else str(v) if isinstance(v, bool) else f"{float(v) + 0.0:.7g}" if isinstance(v, (int, float, Decimal)) else str(v)[:10] if isinstance(v, datetime.date) else str(v)
    return sorted(tuple(text(v) for v in r) for r in rows)


def names():
    from panelyard import queries

    return sorted(queries.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"create view {table.removesuffix('.parquet')} as select * from '{SF}/{table}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", names())
def test_against_duckdb(spark, duck, name):
    from panelyard import queries

    got = queries.queries()[name](spark, SF)
    expected = duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(expected.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_price_pivot_has_every_asset(spark):
    import duckdb

    import __spark_entry__ as entry

    expected = duckdb.sql(f"SELECT CAST(date_trunc('month', l_shipdate) AS DATE), l_suppkey, sum(l_extendedprice) / sum(l_quantity) FROM '{SF}/lineitem.parquet' GROUP BY 1, 2").fetchall()
    got = entry.queries()["panel_price_pivot"](spark, SF)
    assert set(got.columns) == {"date", "asset", "price"}
    cells = {(str(r["date"])[:10], int(r["asset"])): r["price"] for r in got.collect() if r["price"] is not None}
    assert cells == {(str(date), asset): pytest.approx(float(close), abs=1e-7) for date, asset, close in expected}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_available_from_knows_every_ship_date(spark):
    import bisect
    import datetime

    import duckdb

    import __spark_entry__ as entry

    days = [d for (d,) in duckdb.sql(f"SELECT DISTINCT CAST(l_shipdate AS DATE) FROM '{SF}/lineitem.parquet' ORDER BY 1").fetchall()]
    got = entry.queries()["market_available_from"](spark, SF).collect()
    assert got
    for r in got:
        base = r["datadate"] + datetime.timedelta(days=30 if r["o_orderkey"] % 3 else 90)
        at = bisect.bisect_right(days, base)
        assert r["available"] == (days[at] if at < len(days) else None)
