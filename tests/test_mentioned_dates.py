"""Dates of questions, one rule after the other."""

import pytest

from filingflow.operators.mentioned_dates import date_mentions


@pytest.mark.parametrize("text,want", [
    ("berita 25 september", ["2026-09-25"]), ("22 dan 25 sept", ["2026-09-22", "2026-09-25"]), ("1, 2 & 3 Okt 2025", ["2025-10-01", "2025-10-02", "2025-10-03"]), ("23-24 sept", ["2026-09-23/2026-09-24"]), ("23 s/d 24 sep 2024", ["2024-09-23/2024-09-24"]),
    ("26/9 dan 2026-09-27", ["2026-09-26", "2026-09-27"]), ("september 22", ["2026-09-22"]), ("3 October 2025 sampai tanggal 5 October", ["2025-10-03/2025-10-05"]), ("3 October dan 5 October", ["2026-10-03", "2026-10-05"]), ("30 september - 2 oktober", ["2026-09-30/2026-10-02"]),
    ("25 septembr, 7 Agustuss dan 3 novembar", ["2026-08-07", "2026-09-25", "2026-11-03"]), ("3 market 5 augusta 4 marzt 2 octopus", []), ("31 februari, 32/1, 2026-13-01", []), ("24-23 sept", []), ("5 oktober sampai 3 oktober", []), ("minggu ini", ["2026-05-18/2026-05-24"]), ("pekan lalu", ["2026-05-11/2026-05-17"]),
    ("stockbit oktober", ["2026-10-01/2026-10-31"]), ("3 oktober di oktober", ["2026-10-03"]), ("februari 2024", ["2024-02-01/2024-02-29"]), ("", []), (None, []), ("12 kali 3", []), ("2 mei 2 mei", ["2026-05-02"]),
])
def test_mentions(spark, text, want):
    rows = date_mentions(spark.createDataFrame([(1, text, "x")], "id int, text string, `from` string"), "id", "text", 2026, "2026-05-20", True).collect()
    assert sorted(str(r["from"]) if r["from"] == r["to"] else f"{r['from']}/{r['to']}" for r in rows) == want


def test_without_year_or_today(spark):
    df = spark.createDataFrame([(1, "5 mei, 6/5, minggu ini, 7 mei 2025, mei"), (2, "mei")], "id int, text string")
    assert [(r.id, str(r["from"])) for r in date_mentions(df, "id", "text", None, None, True).collect()] == [(1, "2025-05-07")]
