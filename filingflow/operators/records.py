"""Documents as records: lines, sections, passages, outlines, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions.text import plain_markdown, squash

HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, line, offset, content): each line with its line end; joined in order they are the text. offset counts signs."""
    parts = F.split(F.col(text_col), "(?<=\n)")
    d = docs.select(id_col, F.posexplode(parts).alias("line", "content")).where("content != '' or line = 0")
    w = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("offset", F.coalesce(F.sum(F.length("content")).over(w), F.lit(0)))


def with_headings(lines: DataFrame, id_col: str) -> DataFrame:
    """Adds level and title of a heading line (outside code fences), and the title of the last heading above."""
    w = Window.partitionBy(id_col).orderBy("line")
    fence = F.sum(F.col("content").rlike(r"^\s*```").cast("int")).over(w) % 2 == 1
    bare = F.rtrim(F.regexp_replace("content", r"[\r\n]+$", ""))
    level = F.when(~fence & bare.rlike(HEADING), F.length(F.regexp_extract(bare, HEADING, 1)))
    out = lines.withColumn("fenced", fence).withColumn("level", level).withColumn("title", F.when(level.isNotNull(), F.regexp_extract(bare, HEADING, 2)))
    return out.withColumn("section", F.last("title", ignorenulls=True).over(w))


def md_info(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Title (first H1), level of the contents (1 if there are several H1, else 2), number of headings of that level, and the first
    paragraph of prose of 40 signs or more."""
    h = with_headings(lines(docs, id_col, text_col), id_col)
    prose = ~F.col("fenced") & F.col("level").isNull() & (F.length(F.trim("content")) >= 40) & ~F.trim("content").rlike(r"^([-*|>]|\d+\.|```)")
    g = h.groupBy(id_col).agg(F.min_by("title", F.when(F.col("level") == 1, F.col("line"))).alias("title"), F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).alias("h1"), F.sum(F.when(F.col("level") == 2, 1).otherwise(0)).alias("h2"), F.min_by("content", F.when(prose, F.col("line"))).alias("p"))
    return g.select(id_col, "title", F.when(F.col("h1") > 1, 1).otherwise(2).alias("level"), F.when(F.col("h1") > 1, F.col("h1")).otherwise(F.col("h2")).alias("headings"), plain_markdown("p").alias("description"))


def html_info(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Title (first h1, else title), first paragraph, and codes of table rows whose table begins with the head 'Kode'."""
    text = lambda c: squash(F.regexp_replace(c, r"<[^>]*>", " "))
    h1 = F.nullif(text(F.regexp_extract(html_col, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), F.lit(""))
    title = F.nullif(text(F.regexp_extract(html_col, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit(""))
    paragraph = F.nullif(text(F.regexp_extract(html_col, r"(?is)<p\b[^>]*>(.*?)</p>", 1)), F.lit(""))
    tables = F.filter(F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1)), lambda t: F.regexp_extract(t, r"(?is)<th\b[^>]*>\s*(\w+)", 1) == "Kode")
    cells = F.flatten(F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>\s*<td\b[^>]*>(.*?)</td>"), F.lit(1))))
    codes = F.array_distinct(F.flatten(F.transform(cells, lambda c: F.split(text(c), r"\s*/\s*"))))
    return pages.select(id_col, F.coalesce(h1, title).alias("title"), paragraph.alias("description"), codes.alias("codes"))


def text_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Words, signs, bytes and lines."""
    squashed = squash(text_col)
    return docs.select(id_col, F.when(squashed == "", 0).otherwise(F.size(F.split(squashed, " "))).alias("words"), F.length(text_col).alias("signs"), F.octet_length(text_col).alias("bytes"), (F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).alias("lines"))


def partition_records(docs: DataFrame, id_col: str, text_col: str, codes: list[str] | None = None, longest: int = 1500) -> DataFrame:
    """Lossless partition into rows (id, ordinal, line, offset, kind, context, content): a heading begins a record and so does a table
    row, a line after a blank one, and a list item once its block is longer than `longest`. context is the heading above; with codes,
    code is the one in it. Joined in order, the contents are the text."""
    h = with_headings(lines(docs, id_col, text_col), id_col)
    w = Window.partitionBy(id_col).orderBy("line")
    blank = F.trim(F.regexp_replace("content", r"[\r\n]", "")) == ""
    h = h.withColumn("blank", blank).withColumn("row", F.col("content").rlike(r"^\s*\|") & ~F.col("fenced")).withColumn("item", F.col("content").rlike(r"^\s*([-*+]|\d+[.)])\s") & ~F.col("fenced"))
    after_blank = F.coalesce(F.lag("blank").over(w), F.lit(False)) & ~F.col("blank") & ~F.col("fenced")
    first = F.col("level").isNotNull() | F.col("row") | F.coalesce(F.lag("row").over(w), F.lit(False)) | F.coalesce(F.lag("level").over(w).isNotNull(), F.lit(False)) | after_blank | F.lag("line").over(w).isNull()
    h = h.withColumn("block", F.sum(first.cast("int")).over(w))
    in_block = Window.partitionBy(id_col, "block")
    long = F.sum(F.length("content")).over(in_block) > longest
    h = h.withColumn("ordinal", F.sum((F.col("item") & long & (F.lag("block").over(w) == F.col("block"))).cast("int")).over(w) + F.col("block"))
    g = h.groupBy(id_col, "ordinal").agg(F.min("line").alias("line"), F.min("offset").alias("offset"), F.min_by("section", "line").alias("context"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "").alias("content"), F.bool_or(F.col("level").isNotNull()).alias("heading"), F.bool_or("row").alias("row"), F.bool_or("item").alias("item"))
    kind = F.when(F.col("heading"), "heading").when(F.col("row"), "row").when(F.col("item"), "item").otherwise("text")
    out = g.select(id_col, "ordinal", "line", "offset", kind.alias("kind"), "context", "content")
    if codes is not None:
        found = F.array_intersect(F.regexp_extract_all(F.coalesce("context", F.lit("")), F.lit(r"\b([A-Z]{4})\b"), F.lit(1)), F.array(*map(F.lit, codes)))
        out = out.withColumn("code", F.get(found, 0))
    return out


def annotate_records(records: DataFrame, id_col: str) -> DataFrame:
    """Codes in capitals, the leading ISO date of a table row, all ISO dates mentioned, and a section id from the document and place."""
    iso = r"\d{4}-\d{2}-\d{2}"
    dates = F.array_compact(F.transform(F.regexp_extract_all("content", F.lit(rf"\b{iso}\b"), F.lit(0)), lambda s: F.try_to_date(s, "yyyy-MM-dd")))
    event = F.when(F.col("kind") == "row", F.try_to_date(F.nullif(F.regexp_extract("content", rf"^\s*\|\s*({iso})\b", 1), F.lit("")), "yyyy-MM-dd"))
    section = F.concat(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 12), F.lit("-"), F.col("offset"))
    return records.withColumn("codes", F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Z]{4})\b"), F.lit(1)))).withColumn("event_date", event).withColumn("dates", F.array_distinct(dates)).withColumn("section_id", section)


def check_lossless(docs: DataFrame, records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whether the records of each document, joined in order, are its text."""
    joined = records.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "").alias("joined"), F.count("*").alias("records"))
    both = docs.select(id_col, text_col).join(joined, id_col, "left")
    return both.select(id_col, F.coalesce("records", F.lit(0)).alias("records"), (F.sha2(F.coalesce("joined", F.lit("")), 256) == F.sha2(F.coalesce(text_col, F.lit("")), 256)).alias("lossless"))


def section_facts(docs: DataFrame, id_col: str, text_col: str, labels: dict[str, str]) -> DataFrame:
    """Under each heading with a code, the first line of each label (name -> pattern)."""
    h = with_headings(lines(docs, id_col, text_col), id_col).withColumn("code", F.nullif(F.regexp_extract("section", r"^([A-Z]{4})\b", 1), F.lit(""))).where("code is not null")
    return h.groupBy(id_col, "code").agg(*(F.min_by(plain_markdown("content"), F.when(F.col("content").rlike(p), F.col("line"))).alias(n) for n, p in labels.items()))


def extract_schedule(docs: DataFrame, id_col: str, text_col: str, least: int = 3) -> DataFrame:
    """'date: text' sentences as rows, if a text has at least so many."""
    date = r"(?i)^\s*[-*]?\s*(\d{1,2}\s+\p{L}+\s+\d{4}|\d{4}-\d{2}-\d{2})\s*:\s*(.+?)\s*$"
    s = docs.select(id_col, F.posexplode(F.split(text_col, r"[\n;]|(?<=\.)\s")).alias("place", "s")).where(F.col("s").rlike(date))
    rows = s.select(id_col, "place", F.regexp_extract("s", date, 1).alias("date"), F.regexp_extract("s", date, 2).alias("event"))
    return rows.join(rows.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(id_col), id_col, "left_semi")


def tag_sentences(docs: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Sentences with the tag of the first rule that they fit."""
    s = docs.select(id_col, F.posexplode(F.split(text_col, r"(?<=[.!?])\s+|\n")).alias("place", "sentence"))
    tag = F.lit(None).cast("string")
    for name, pattern in rules:
        tag = F.coalesce(tag, F.when(F.col("sentence").rlike(pattern), F.lit(name)))
    return s.withColumn("tag", tag).where("tag is not null")


def best_passage(lines: DataFrame, id_col: str, anchor: str, cues: list[str], least: int = 4) -> DataFrame:
    """Of each document the passage (lines between two headings) that holds the anchor and the most cue words, if at least so many."""
    w = Window.partitionBy(id_col).orderBy("line")
    part = lines.withColumn("part", F.sum(F.col("content").rlike(HEADING).cast("int")).over(w))
    score = sum((F.regexp_count(F.lower("content"), F.lit(c)) for c in cues), F.lit(0))
    g = part.groupBy(id_col, "part").agg(F.bool_or(F.col("content").rlike(anchor)).alias("anchored"), F.sum(score).alias("score"), F.min("line").alias("first"), F.max("line").alias("last"))
    return g.where(F.col("anchored") & (F.col("score") >= least)).groupBy(id_col).agg(F.max_by(F.struct("first", "last", "score"), F.struct("score", -F.col("part"))).alias("b")).select(id_col, "b.*")


def document_facts(records: DataFrame, id_col: str) -> DataFrame:
    """Per document and date of table rows: rows and distinct codes."""
    rows = records.where("event_date is not null")
    return rows.groupBy(id_col, "event_date").agg(F.count("*").alias("rows"), F.size(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))


def outline(lines: DataFrame, id_col: str, cap: int) -> DataFrame:
    """Everything before the first heading with a code, then one line a later heading, while the bytes stay within the cap."""
    w = Window.partitionBy(id_col).orderBy("line")
    coded = F.col("content").rlike(r"^#{1,6}\s+(?:\d+\.\s*)?[A-Z]{4}\b")
    past = F.sum(coded.cast("int")).over(w) > 0
    kept = lines.where(F.lit(True)).withColumn("past", past).where(~F.col("past") | F.col("content").rlike(HEADING))
    return kept.withColumn("bytes", F.sum(F.octet_length("content")).over(w)).where(F.col("bytes") <= cap).drop("past")


def merge_equal_context(records: DataFrame, id_col: str) -> DataFrame:
    """Consecutive records of one context as one."""
    w = Window.partitionBy(id_col).orderBy("ordinal")
    r = records.withColumn("island", F.sum((~F.lag("context").over(w).eqNullSafe(F.col("context"))).cast("int")).over(w))
    return r.groupBy(id_col, "island").agg(F.min("ordinal").alias("ordinal"), F.first("context").alias("context"), F.count("*").alias("records"), F.sum(F.length("content")).alias("signs"))


def trim_lists(lines: DataFrame, id_col: str, term: Column) -> DataFrame:
    """Of long lists keep headings and the items that hold the term; count what is left out."""
    item = F.col("content").rlike(r"^\s*[-*]\s")
    g = lines.withColumn("keep", ~item | term)
    return g.groupBy(id_col).agg(F.sum(F.col("keep").cast("bigint")).alias("kept"), F.sum((~F.col("keep")).cast("bigint")).alias("dropped"))
