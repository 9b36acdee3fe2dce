"""Checks of claims against their SQL where claims are of months after the last holdings."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as e


@pytest.fixture(scope="module")
def later(tmp_path_factory, sf):
    d = tmp_path_factory.mktemp("later")
    duckdb.sql(f"COPY (SELECT * REPLACE (ts + to_days(CAST(event_id % 3 * 25 AS INTEGER)) AS ts) FROM '{sf}/events.parquet') TO '{d}/events.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["L05_trend_check", "L06_check_claims"])
def test_claims_after_the_last_holdings(spark, later, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{later}/events.parquet'")
    cur = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    theirs = Counter(tuple(map(str, r)) for r in cur.fetchall())
    mine = Counter(tuple(map(str, r)) for r in e.queries()[name](spark, later).select(columns).collect())
    assert mine and mine == theirs
