"""Registered queries against their SQL where several users have one code: there are 26 ** 3 codes, and larger tables have more users."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as e


@pytest.fixture(scope="module")
def many_users(tmp_path_factory, sf):
    d = tmp_path_factory.mktemp("many_users")
    shifts = "[0, 17500, 17576, 35159, 52735]"
    more = f"SELECT t.* REPLACE (event_id + r.k * 1000003 AS event_id, user_id + ({shifts})[r.k + 1] AS user_id) FROM range(5) r(k), '{sf}/events.parquet' t WHERE r.k <> 2 OR event_id % 3 = 0"
    duckdb.sql(f"COPY (SELECT * FROM ({more}) WHERE user_id <> 1 OR event_type <> 'error' UNION ALL (SELECT * REPLACE (7000008 AS event_id, 17577 AS user_id, 'error' AS event_type) FROM '{sf}/events.parquet' LIMIT 1)) TO '{d}/events.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["C05_scan_mentions", "X06_prune_comentions", "L05_trend_check", "L06_check_claims"])
def test_codes_of_several_users(spark, many_users, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{many_users}/events.parquet'")
    cur = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    theirs = Counter(tuple(map(str, r)) for r in cur.fetchall())
    mine = Counter(tuple(map(str, r)) for r in e.queries()[name](spark, many_users).select(columns).collect())
    assert mine and mine == theirs
