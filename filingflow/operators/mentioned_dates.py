"""Dates and ranges of dates that a question mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.functions.dates import day

# Words for months in questions, words one letter away from a month that are none, words between the ends of a range.
MONTH_WORDS = {
    "januari": 1, "january": 1, "jan": 1, "februari": 2, "february": 2, "feb": 2, "maret": 3, "march": 3, "mar": 3, "april": 4, "apr": 4, "mei": 5, "may": 5, "juni": 6, "june": 6, "jun": 6, "juli": 7, "july": 7, "jul": 7,
    "agustus": 8, "august": 8, "agu": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "oktober": 10, "october": 10, "okt": 10, "oct": 10, "november": 11, "nov": 11, "desember": 12, "december": 12, "des": 12, "dec": 12,
}
NOT_MONTHS = ["market", "markets", "marah", "marsh", "marco", "marek", "augusta", "augusti", "augustus"]
MONTHS_ALONE = "januari|january|februari|february|maret|march|april|mei|juni|june|juli|july|agustus|august|september|oktober|october|november|desember|december"
MONTH = "|".join(MONTH_WORDS)
BETWEEN, LISTED = r"sampai|hingga|s/d|-|–", r",|&|dan|-|–|sampai|hingga|s/d"
ENDPOINT = rf"(?:20\d{{2}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[/-]\d{{1,2}}(?:[/-]20\d{{2}})?|\d{{1,2}}\s+(?:{MONTH})(?:\s+20\d{{2}})?)"
RANGE = rf"(?i)\b({ENDPOINT})\s*(?:sampai|hingga|s/d|[–—-])\s*(?:(?:tanggal|tgl|tggl)\s*)?({ENDPOINT})\b"
LIST = rf"(?i)\b(\d{{1,2}})((?:\s*(?:{LISTED})\s*\d{{1,2}})*)\s+({MONTH})\b(?:\s+(20\d{{2}}))?"
SPANS = "array<struct<from:date,to:date>>"


def _month_forms() -> dict[str, str]:
    """Month names of six letters and more under themselves and under each form with one letter deleted: words one edit apart share one."""
    out: dict[str, str] = {}
    for m in [m for m in MONTH_WORDS if len(m) >= 6]:
        for form in [m, *(m[:i] + m[i + 1 :] for i in range(len(m)))]:
            out.setdefault(form, m)
    return out


def month_for(word: Column) -> Column:
    """The month that a word of six letters and more means, perhaps misspelled by one edit after its first three letters; else null."""
    w = F.lower(word)
    forms = F.create_map(*(F.lit(x) for kv in _month_forms().items() for x in kv))
    own = F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))
    near = F.filter(F.transform(own, lambda f: F.try_element_at(forms, f)), lambda m: m.isNotNull() & (F.substring(m, 1, 3) == F.substring(w, 1, 3)) & (F.levenshtein(m, w) <= 1))
    return F.when((F.length(w) >= 6) & ~w.isin(*MONTH_WORDS, *NOT_MONTHS), F.get(near, F.lit(0)))


def plain_months(text: Column) -> Column:
    """A text in which misspelled months beside a day are spelled right, and the day stands before its month."""
    beside = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"\b\d{1,2}\s+([A-Za-z]{6,})\b"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]{6,})\s+\d{1,2}(?!\d)"), F.lit(1))))
    wrong = F.filter(beside, lambda w: month_for(w).isNotNull())
    fixed = F.aggregate(wrong, text, lambda t, w: F.regexp_replace(t, F.concat(F.lit(r"\b"), w, F.lit(r"\b")), month_for(w)))
    return F.regexp_replace(fixed, rf"(?i)\b({MONTH})\s+(\d{{1,2}})(?!\d)\b,?", "$2 $1")


def _number(month: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MONTH_WORDS.items() for x in kv)), F.lower(month)).cast("string")


def _endpoint(text: Column) -> dict[str, Column]:
    got = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    iso, marks, words = r"^(20\d{2})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[/-](\d{1,2})(?:[/-](20\d{2}))?$", rf"(?i)^(\d{{1,2}})\s+({MONTH})(?:\s+(20\d{{2}}))?$"
    return {"y": F.coalesce(got(iso, 1), got(marks, 3), got(words, 3)), "m": F.coalesce(got(iso, 2), got(marks, 2), _number(got(words, 2))), "d": F.coalesce(got(iso, 3), got(marks, 1), got(words, 1))}


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All matches as structs (g1, ..., gn); a group without a match is empty."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(1, n + 1)))


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.alias("from"), b.alias("to"))


def date_mentions(df: DataFrame, id_col: str, text_col: str, year: int | None = None, today: str | None = None, months: bool = False) -> DataFrame:
    """Rows (id, from, to) of the dates that a text mentions, each once; a single date is a range of one day. Ranges of two written dates
    come first and are taken out of the text; then ISO dates, day/month[/year], and days with a month: one, a list, or a range. Where no
    year is written, a range takes it from its other end, and all else is of the given year, or none without. "minggu ini" and "pekan
    lalu" are weeks from Monday by today's date. With months, a month alone is all its days, if no day was written. A month of six
    letters and more may have one letter wrong. What is no date, or ends before it begins, is left out; null texts mention none."""
    default = F.lit(None if year is None else str(year)).cast("string")
    t = df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_asked"), plain_months(F.col(text_col)).alias("_text"))

    def ranged(g: Column) -> Column:
        a, b = _endpoint(g["g1"]), _endpoint(g["g2"])
        return _span(day(F.coalesce(a["y"], b["y"], default), a["m"], a["d"]), day(F.coalesce(b["y"], a["y"], default), b["m"], b["d"]))

    t = t.withColumn("_ranges", F.transform(_groups(F.col("_text"), RANGE, 2), ranged)).withColumn("_text", F.regexp_replace("_text", RANGE, " "))
    one = lambda d: _span(d, d)
    iso = F.transform(_groups(F.col("_text"), r"\b(20\d{2})-(\d{1,2})-(\d{1,2})\b", 3), lambda g: one(day(g["g1"], g["g2"], g["g3"])))
    marks = F.transform(_groups(F.col("_text"), r"\b(\d{1,2})/(\d{1,2})(?:/(20\d{2}))?\b", 3), lambda g: one(day(F.coalesce(F.nullif(g["g3"], F.lit("")), default), g["g2"], g["g1"])))

    def listed(g: Column) -> Column:
        y, m = F.coalesce(F.nullif(g["g4"], F.lit("")), default), _number(g["g3"])
        more = F.regexp_extract_all(g["g2"], F.lit(rf"(?i)({LISTED})\s*(\d{{1,2}})"), F.lit(2))
        sign = F.regexp_extract(g["g2"], rf"(?i)({LISTED})\s*\d{{1,2}}", 1)
        is_range = (F.size(more) == 1) & sign.rlike(rf"(?i)^(?:{BETWEEN})$")
        return F.when(is_range, F.array(_span(day(y, m, g["g1"]), day(y, m, F.get(more, F.lit(0)))))).otherwise(F.transform(F.concat(F.array(g["g1"]), more), lambda d: one(day(y, m, d))))

    lists = F.flatten(F.transform(_groups(F.col("_text"), LIST, 4), listed))
    week = F.lower(F.regexp_extract("_asked", r"(?i)\b(?:minggu|pekan)\s+(ini|lalu|kemarin)\b", 1))
    monday = F.date_sub(F.date_trunc("week", F.lit(today).cast("date")).cast("date"), F.when(week == "ini", 0).otherwise(7))
    weeks = F.when((week != "") & F.lit(today is not None), F.array(_span(monday, F.date_add(monday, 6)))).otherwise(F.array().cast(SPANS))
    real = lambda spans: F.filter(spans, lambda s: F.coalesce(s["from"] <= s["to"], F.lit(False)))
    t = t.withColumn("_spans", real(F.concat("_ranges", iso, marks, lists, weeks)))
    if months:
        whole = F.transform(_groups(F.col("_text"), rf"(?i)\b({MONTHS_ALONE})\b(?:\s+(20\d{{2}}))?", 2), lambda g: F.struct(day(F.coalesce(F.nullif(g["g2"], F.lit("")), default), _number(g["g1"]), F.lit("1")).alias("from")))
        whole = F.transform(whole, lambda s: _span(s["from"], F.last_day(s["from"])))
        bare = (F.size("_spans") == 0) & ~F.col("_text").rlike(rf"(?i)\b\d{{1,2}}\s+(?:{MONTH})\b|\b\d{{1,2}}[/-]\d{{1,2}}\b")
        t = t.withColumn("_spans", F.when(bare, real(whole)).otherwise(F.col("_spans")))
    return t.select(id_col, F.explode(F.array_distinct("_spans")).alias("_s")).select(id_col, "_s.from", "_s.to").distinct()
