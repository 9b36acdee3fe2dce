"""Column functions on dates written in names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months in the catalogue's language and in English, days of the week from Sunday.
MONTHS = {
    "januari": 1, "februari": 2, "maret": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "agustus": 8, "september": 9, "oktober": 10, "november": 11, "desember": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "august": 8, "october": 10, "december": 12,
}
LOCAL_MONTHS = ["Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember"]
LOCAL_DAYS = ["Minggu", "Senin", "Selasa", "Rabu", "Kamis", "Jumat", "Sabtu"]
#: Month names and their first three letters, longest first.
NAME = "(" + "|".join(sorted({*MONTHS, *(m[:3] for m in MONTHS)}, key=lambda m: (-len(m), m))) + ")"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_number(col: Column | str) -> Column:
    """By the first three letters, which tell all spellings."""
    by_head = F.create_map(*(F.lit(x) for kv in sorted({m[:3]: n for m, n in MONTHS.items()}.items()) for x in kv))
    return F.try_element_at(by_head, F.substring(F.lower(_c(col)), 1, 3))


def day(year: Column, month: Column, number: Column) -> Column:
    """A date, or null if there is none."""
    return F.try_to_date(F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(number.cast("string"), 2, "0")), "yyyy-MM-dd")


def _parts(col: Column, pattern: str, n: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(col, pattern, k), F.lit("")) for k in range(1, n + 1)]


def parse_name_dates(col: Column | str) -> Column:
    """The span that a document's name tells, the first rule that gives real dates: two ISO dates; an ISO date, perhaps with a last
    day; day or days with month and year; the same without separators at the end; months of a year; eight digits, year or day first.
    Separators are blanks, lines and underscores. An end before the start counts as the start, but for two full dates."""
    c = _c(col)
    iso = r"(\d{4})-(\d{2})-(\d{2})"
    one = F.lit("1")

    def rule(y1, m1, d1, y2, m2, d2, kind="day"):
        names = ("y1", "m1", "d1", "y2", "m2", "d2", "kind")
        return F.struct(*(x.cast("string").alias(n) for x, n in zip((y1, m1, d1, y2, m2, d2, F.lit(kind)), names)))

    patterns = [
        (iso + r"[_\-\s]+(?:to[_\-\s]+)?" + iso, 6), (iso + r"(?:_(\d{1,2})(?!\d))?", 4), (rf"(?i)(?<!\d)(\d{{1,2}})(?:[_\-–](\d{{1,2}}))?[_\- ]{NAME}[_\- ](\d{{4}})", 4),
        (rf"(?i)(?<!\d)(\d{{1,2}}){NAME}(\d{{4}})$", 3), (rf"(?i)(?<![A-Za-z]){NAME}[_\- ]+(?:{NAME}[_\- ]+)?(\d{{4}})", 3),
    ]

    def rules(found: Column) -> Column:
        p = [[found[f"p{i}_{k}"] for k in range(n)] for i, (_, n) in enumerate(patterns)]
        y, m, d, y2, m2, d2 = p[0]
        out = [rule(y, m, d, y2, m2, d2, "written")]
        y, m, d, last = p[1]
        out += [rule(y, m, d, y, m, last), rule(y, m, d, y, m, d)]
        a, b, mon, y = p[2]
        out.append(rule(y, month_number(mon), a, y, month_number(mon), F.coalesce(b, a)))
        a, mon, y = p[3]
        out.append(rule(y, month_number(mon), a, y, month_number(mon), a))
        mon, mon2, y = p[4]
        out.append(rule(y, month_number(mon), one, y, month_number(F.coalesce(mon2, mon)), one, "month"))
        return F.array(*out)

    # Values that several expressions read are bound once by a lambda over an array of one: each pattern is matched once a group.
    bound = F.array(F.struct(*(x.alias(f"p{i}_{k}") for i, (pattern, n) in enumerate(patterns) for k, x in enumerate(_parts(c, pattern, n)))))
    eight = F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{8})(?!\d)"), F.lit(1))
    part = lambda x, lo, n: F.substring(x, lo, n)
    year_first = lambda x: rule(part(x, 1, 4), part(x, 5, 2), part(x, 7, 2), part(x, 1, 4), part(x, 5, 2), part(x, 7, 2), "20")
    day_first = lambda x: rule(part(x, 5, 4), part(x, 3, 2), part(x, 1, 2), part(x, 5, 4), part(x, 3, 2), part(x, 1, 2), "20")
    all_rules = F.concat(F.flatten(F.transform(bound, rules)), F.flatten(F.transform(eight, lambda x: F.array(year_first(x), day_first(x)))))

    def dated(r: Column) -> Column:
        return F.struct(day(r["y1"], r["m1"], r["d1"]).alias("start"), day(r["y2"], r["m2"], r["d2"]).alias("last"), r["kind"].alias("kind"), r["y1"].alias("y1"))

    def real(r: Column) -> Column:
        return r["start"].isNotNull() & r["last"].isNotNull() & ((r["kind"] != "month") | (r["start"] <= r["last"])) & ((r["kind"] != "20") | r["y1"].startswith("20"))

    def span(r: Column) -> Column:
        end = F.when(r["kind"] == "month", F.last_day(r["last"])).when(r["kind"] == "written", r["last"]).otherwise(F.greatest(r["start"], r["last"]))
        return F.struct(r["start"].alias("start"), end.alias("end"), F.when(r["kind"] == "month", "month").otherwise("day").alias("precision"))

    # Rules are read one by one in a lambda: as nested expressions their code would be too large to compile.
    return F.get(F.transform(F.filter(F.transform(all_rules, dated), real), span), 0)


def date_label(start: Column | str, end: Column | str, precision: Column | str) -> Column:
    """A span in words: days, months, or one of them where both ends agree."""
    start, end, precision = _c(start), _c(end), _c(precision)
    names = F.array(*map(F.lit, LOCAL_MONTHS))
    month = lambda c: F.get(names, F.month(c) - 1)
    full = lambda c: F.concat_ws(" ", F.dayofmonth(c), month(c), F.year(c))
    same_month = F.date_trunc("month", start) == F.date_trunc("month", end)
    by_month = F.when(same_month, F.concat_ws(" ", month(start), F.year(start))).otherwise(F.concat(month(start), F.lit("–"), month(end), F.lit(" "), F.year(end)))
    by_day = F.when(start == end, full(start)).when(same_month, F.concat(F.dayofmonth(start), F.lit("–"), full(end))).otherwise(F.concat(full(start), F.lit("–"), full(end)))
    return F.when(precision == "month", by_month).otherwise(by_day)


def weekday_name(col: Column | str) -> Column:
    return F.get(F.array(*map(F.lit, LOCAL_DAYS)), F.dayofweek(_c(col)) - 1)
