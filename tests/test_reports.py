"""Issuer reports on small fixtures."""

import datetime as dt

from filingflow.operators import reports as P


def d(s):
    return dt.date.fromisoformat(s)


def test_blocks_and_written(spark):
    rows = [("E", d("2026-01-01"), "a", 60, 100, 60.0), ("E", d("2026-01-01"), "b", 39, 100, 39.0), ("E", d("2026-01-01"), "c", 1, 100, 1.0), ("F", d("2026-01-01"), "a", None, 100, 50.0)]
    h = spark.createDataFrame(rows, "entity string, period date, party string, shares bigint, total bigint, pct double")
    got = {r.entity: (r.block_shares, r.reconciled) for r in P.blockholders(h).collect()}
    assert got == {"E": (99, True), "F": (0, False)}
    assert P.written_block(h.where("entity = 'E'")).first().written == 99.0


def test_compare_and_variants(spark):
    s = "name string, role string, shares bigint"
    a = spark.createDataFrame([("x", "r", 1), ("y", "r", 2), ("PT Maju", "r", 5)], s)
    b = spark.createDataFrame([("x", "r", 3), ("y", "q", 4), ("Maju Tbk", "r", 5)], s)
    assert {(r.name, r.how) for r in P.compare_reports(a, b).collect()} == {("x", "role"), ("y", "name"), ("PT Maju", "only_a"), ("Maju Tbk", "only_b")}
    assert [tuple(r) for r in P.match_variants(a.where("shares = 5"), b.where("shares = 5")).collect()] == [("PT Maju", "Maju Tbk")]


def test_roles_flags_cards(spark):
    h = spark.createDataFrame([("E", d("2026-01-01"), "Afiliasi", 5, ["affiliate", "block"]), ("E", d("2026-01-01"), "x", 9, None)], "entity string, period date, name string, shares bigint, roles array<string>")
    assert [(r.name, r.role_bits, r.aggregate) for r in P.report_rows(h).collect()] == [("x", None, False), ("Afiliasi", 5, True)]
    f = spark.createDataFrame([("E", "bad", ["rounding"]), ("F", "bad", ["conflict: x"]), ("G", None, None)], "entity string, validation string, issues array<string>")
    assert {r.entity: (r.comparable, r.conflict) for r in P.trust_flags(f, ["rounding"]).collect()} == {"E": (True, False), "F": (False, True), "G": (False, False)}
    c = spark.createDataFrame([(1, d("2026-01-10"), 5, 8, [(3, 2.0, d("2026-01-07")), (1, 4.0, d("2026-01-02"))])], "id int, date date, before bigint, after bigint, tx array<struct<shares:bigint,price:double,date:date>>")
    assert tuple(P.filing_cards(c).first()) == (1, 10.0, 3, 3)
    rows = spark.createDataFrame([("u", d("2026-01-05"), "p", 1500, "beli 1.500 saham"), ("v", d("2026-01-01"), "p", 1, "")], "url string, date date, party string, shares bigint, text string")
    audit = spark.createDataFrame([("u", d("2026-01-05"), "percent", "n1"), ("u", d("2026-01-05"), "other", "n2")], "url string, date date, kind string, note string")
    assert [r.notes for r in P.filings(rows, audit, "2026-01-01", "2026-01-31").collect()] == [["n1", "n2"]]
    v = spark.createDataFrame([("E", d("2026-01-01"), "a", 1, 1.0, 10), ("E", d("2026-01-01"), "a", 1, 1.0, 10), ("F", d("2026-01-01"), "a", 1, 1.0, 10), ("F", d("2026-01-01"), "a", 2, 1.0, 10)], "entity string, period date, name string, shares bigint, pct double, total bigint")
    assert {r.entity: r.derivable for r in P.derivable(v).collect()} == {"E": True, "F": False}
    m = spark.createDataFrame([("E", d("2026-01-01"), "m", 1.0, True), ("E", d("2026-01-01"), "m", 2.0, False)], "entity string, period date, metric string, value double, chosen boolean")
    assert P.report_metrics(m).first().others == [2.0]
    s = spark.createDataFrame([("E", 1, 1500, "Budi Santoso"), ("E", 2, 77, "Andi Wijaya")], "entity string, id int, shares bigint, names string")
    ans = spark.createDataFrame([("E", "1.500 saham")], "entity string, answer string")
    assert [r.id for r in P.uncovered_signals(s, ans, "entity").collect()] == [2]
