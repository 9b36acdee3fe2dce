"""Catalogue of documents with spans and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions.dates import NAME, day, month_number
from filingflow.operators.relational import explode_days


def text_date_ranges(docs: DataFrame, id_col: str, text_col: str, signs: int = 5000) -> DataFrame:
    """Spans written at the head of a text: first those over two months ('1 Agustus – 5 September 2026', the first year may be
    missing), then those within one ('22–24 September 2026'). The head is the feature: a document's date line stands there."""
    head = F.substring(text_col, 1, signs)
    two = rf"(?i)(\d{{1,2}})\s+{NAME}(?:\s+(\d{{4}}))?\s*[–-]\s*(\d{{1,2}})\s+{NAME}\s+(\d{{4}})"
    one = rf"(?i)(?<!\d)(\d{{1,2}})\s*[–-]\s*(\d{{1,2}})\s+{NAME}\s+(\d{{4}})"
    written = F.concat(F.regexp_extract_all(head, F.lit(two), F.lit(0)), F.regexp_extract_all(head, F.lit(one), F.lit(0)))
    found = docs.select(id_col, F.posexplode(written).alias("place", "written"))
    part = lambda p, k: F.nullif(F.regexp_extract("written", p, k), F.lit(""))
    both = F.col("written").rlike(two)
    start = F.when(both, day(F.coalesce(part(two, 3), part(two, 6)), month_number(part(two, 2)), part(two, 1))).otherwise(day(part(one, 4), month_number(part(one, 3)), part(one, 1)))
    end = F.when(both, day(part(two, 6), month_number(part(two, 5)), part(two, 4))).otherwise(day(part(one, 4), month_number(part(one, 3)), part(one, 2)))
    return found.select(id_col, "place", start.alias("start"), end.alias("end")).where("start <= end")


def refine_dates(docs: DataFrame, ranges: DataFrame, id_col: str) -> DataFrame:
    """docs (id, start, end, precision): a month becomes the first range inside it, a single day the first range of up to 62 days
    that starts on it."""
    r = ranges.select(id_col, "place", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = (F.col("precision") == "month") & (F.col("r_start") >= F.col("start")) & (F.col("r_end") <= F.col("end"))
    begins = (F.col("precision") == "day") & (F.col("start") == F.col("end")) & (F.col("r_start") == F.col("start")) & (F.datediff("r_end", "r_start") <= 62)
    best = docs.join(r, id_col).where(inside | begins).groupBy(id_col).agg(F.min_by(F.struct("r_start", "r_end"), "place").alias("b"))
    out = docs.join(best, id_col, "left")
    return out.select(id_col, F.coalesce("b.r_start", "start").alias("start"), F.coalesce("b.r_end", "end").alias("end"), F.when(F.col("b").isNotNull(), "day").otherwise(F.col("precision")).alias("precision"))


def covers(docs: DataFrame, ranges: DataFrame, id_col: str) -> DataFrame:
    """What a document of one day talks about: the first range of up to 31 days that ends on that day, else its own span."""
    r = ranges.select(id_col, "place", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    best = docs.where("start = end").join(r, id_col).where((F.col("r_end") == F.col("end")) & (F.datediff("r_end", "r_start") <= 31)).groupBy(id_col).agg(F.min_by("r_start", "place").alias("from"))
    return docs.join(best, id_col, "left").select(id_col, F.coalesce("from", "start").alias("start"), "end")


def categorize(df: DataFrame, name: str, rules: list[tuple[str, list[str], list[str]]], special: dict[str, str] | None = None) -> DataFrame:
    """Category by (category, prefixes, keywords) in order: a special prefix, then the first word among prefixes, then a keyword
    anywhere, else 'other'."""
    lower = F.lower(F.col(name))
    first = F.regexp_extract(lower, r"^([\p{L}\p{N}]+)", 1)
    out = F.lit(None).cast("string")
    for prefix, cat in (special or {}).items():
        out = F.coalesce(out, F.when(lower.startswith(prefix), F.lit(cat)))
    for cat, prefixes, _ in rules:
        out = F.coalesce(out, F.when(first.isin(prefixes), F.lit(cat)))
    for cat, _, words in rules:
        for w in words:
            out = F.coalesce(out, F.when(lower.contains(w), F.lit(cat)))
    return df.withColumn("cat", F.coalesce(out, F.lit("other")))


def coverage(df: DataFrame, family: str, date: str, weekdays_only: bool) -> DataFrame:
    """First and last day of each family, and its missing days between them, perhaps only Monday to Friday."""
    days = df.select(F.col(family).alias("family"), F.col(date).alias("day")).where("family is not null and day is not null").distinct()
    ends = days.groupBy("family").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    calendar = ends.select("family", F.explode(F.sequence("first", "last")).alias("day"))
    if weekdays_only:
        calendar = calendar.where(~F.dayofweek("day").isin(1, 7))
    missing = calendar.join(days, ["family", "day"], "left_anti").groupBy("family").agg(F.array_sort(F.collect_list("day")).alias("missing"))
    return ends.join(missing, "family", "left").select("family", "first", "last", F.coalesce(F.size("missing"), F.lit(0)).alias("n_missing"), F.coalesce(F.array_join(F.transform("missing", lambda d: d.cast("string")), ","), F.lit("")).alias("missing"))


def drop_twins(docs: DataFrame, kind: str, loser: str, winner: str, keys: list[str]) -> DataFrame:
    """Without documents of one kind where one of the other kind has the same keys."""
    wins = docs.where(F.col(kind) == winner).select(*keys).distinct()
    twins = docs.where(F.col(kind) == loser).join(wins, keys, "left_semi")
    return docs.join(twins.select("doc_id"), "doc_id", "left_anti")


def group_by_span(docs: DataFrame) -> DataFrame:
    """Documents of one span together, newest span first; titles in order inside."""
    g = docs.groupBy("start", "end").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("title").cast("string"))), ",").alias("titles"))
    return g.orderBy(F.desc("end"), F.desc("start"))


def flag_stale(docs: DataFrame, days: int) -> DataFrame:
    """Whether a document ends more than so many days before the newest of its category."""
    newest = docs.groupBy("cat").agg(F.max("end").alias("newest"))
    return docs.join(F.broadcast(newest), "cat").select("doc_id", "cat", "end", (F.col("end") < F.date_sub("newest", days)).alias("stale"))


def latest_per(docs: DataFrame, key: str) -> DataFrame:
    """Documents that end last in their category, ties included."""
    newest = docs.groupBy(key).agg(F.max("end").alias("end"))
    return docs.join(newest, [key, "end"], "left_semi")


def prefer_sources(docs: DataFrame, least_days: int = 3) -> DataFrame:
    """docs (doc_id, kind: weekly, daily or raw, start, end), all within the request: a weekly with at least so many days replaces
    the dailies it covers, dailies that stay replace raw reports whose days they or weeklies all cover."""
    spans = explode_days(docs.select("doc_id", "kind", "start", "end"), "start", "end")
    size = spans.groupBy("doc_id").agg(F.count("*").alias("n"))
    weekly = spans.where("kind = 'weekly'").join(size, "doc_id").where(F.col("n") >= least_days).select("day").distinct()
    uncovered = lambda kind, by: spans.where(F.col("kind") == kind).join(by, "day", "left_anti").select("doc_id").distinct()
    daily = docs.where("kind = 'daily'").join(uncovered("daily", weekly), "doc_id", "left_semi")
    by = weekly.union(explode_days(daily.select("start", "end"), "start", "end").select("day")).distinct()
    raw = docs.where("kind = 'raw'").join(uncovered("raw", by), "doc_id", "left_semi")
    return docs.where("kind = 'weekly'").unionByName(daily).unionByName(raw)


def active_span(series: DataFrame, keys: list[str], period: str, metrics: list[str]) -> DataFrame:
    """First and last period with any metric."""
    known = F.coalesce(*(F.col(m).cast("string") for m in metrics)).isNotNull()
    return series.where(known).groupBy(*keys).agg(F.min(period).alias("first"), F.max(period).alias("last"))


def series_segments(points: DataFrame, keys: list[str], period: str, source: str) -> DataFrame:
    """Segments of consecutive monthly points of one source: a gap of more than a month or another source begins a new one."""
    w = Window.partitionBy(*keys).orderBy(period)
    new = (F.months_between(period, F.lag(period).over(w)) != 1) | ~F.lag(source).over(w).eqNullSafe(F.col(source)) | F.lag(period).over(w).isNull()
    numbered = points.withColumn("segment", F.sum(new.cast("int")).over(w))
    return numbered.groupBy(*keys, "segment").agg(F.min(period).alias("first"), F.max(period).alias("last"), F.count("*").alias("n"))


def fingerprint(df: DataFrame) -> DataFrame:
    """sha|updated|state of a file; a state that ends in 'provisional' is marked."""
    return df.withColumn("fingerprint", F.concat_ws("|", "sha", "updated", "state")).withColumn("provisional", F.coalesce(F.col("state").endswith("provisional"), F.lit(False)))


def filter_event_date(df: DataFrame, date: str, mentions: str, wanted: str) -> DataFrame:
    """Rows without a date, of the date, or that mention it."""
    d = F.lit(wanted).cast("date")
    return df.where(F.col(date).isNull() | (F.col(date) == d) | F.coalesce(F.array_contains(mentions, d), F.lit(False)))
