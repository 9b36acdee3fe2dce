"""D14 takes a document's whole span, however long it is, and gives each pair of a document and a range."""

import datetime as dt

import __spark_entry__

CATS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DAY = dt.date(1995, 1, 1)


def _tables(spark, folder, spans, parts):
    day = lambda n: DAY + dt.timedelta(days=n)
    tables = {
        "orders": ([(k, CATS[c], "F", 1, day(a)) for k, c, a, _ in spans], "o_orderkey bigint, o_orderpriority string, o_orderstatus string, o_custkey bigint, o_orderdate date"),
        "lineitem": ([(k, day(x)) for k, _, a, b in spans for x in (a, b)], "l_orderkey bigint, l_shipdate date"),
        "part": (parts, "p_partkey bigint, p_size int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def _pairs(spark, folder):
    return sorted((r.doc_id, r.range_id) for r in __spark_entry__.queries()["D14_overlap_join"](spark, str(folder)).collect())


def test_long_spans_meet_late_ranges(spark, tmp_path):
    # Part k begins k * 13 days after the first day and is of category k % 5.
    _tables(spark, tmp_path, [(1, 0, 0, 120), (2, 0, 0, 64), (3, 1, 0, 400)], [(5, 0), (10, 3), (6, 2), (26, 9), (31, 9)])
    assert _pairs(spark, tmp_path) == [(1, 5), (3, 6), (3, 26)]


def test_equal_spans_are_pairs_of_their_own(spark, tmp_path):
    # Parts 5 and 2005 begin on one day and are of one category.
    _tables(spark, tmp_path, [(1, 0, 0, 120), (2, 0, 0, 120), (3, 0, 66, 70)], [(5, 0), (2005, 0), (2010, 0)])
    assert _pairs(spark, tmp_path) == [(1, 5), (1, 2005), (2, 5), (2, 2005)]
