"""Issuer sections of Markdown documents and lossless partitions of Markdown, HTML and CSV documents into records."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.operators.html_records import outermost
from filingflow.operators.packing import with_packs

# What a heading and a list item look like, signs from which on a block is split at its items, signs of a context's part.
HEADING = r"^(#{1,6})\s+([^\n]+)"
ITEM = r"(?:[-*+]|[0-9]{1,3}[.)])[ \t]+\S|\[\^[^\]\s]+\]:"
LIST_SPLIT = 1500
#: Noncharacters of Unicode, which no text holds: places where a text may be cut.
CUT, ITEM_CUT, FENCE = "\ufdd1", "\ufdd2", "\ufdd3"


def heading_code(title: Column) -> Column:
    """The word of capitals and digits that a heading begins with, after its number; null without one."""
    bare = F.regexp_replace(F.regexp_replace(title, r"[*`]", ""), r"^[\d.()\s]+", "")
    return F.nullif(F.regexp_extract(bare, r"(?U)^([A-Z0-9]{2,8})(?=\W|$)", 1), F.lit(""))


def _segments(docs: DataFrame, id_col: str, text_col: str, codes: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (id, segment, text, level, code) of a text cut before every heading line, with the owner of each: a coded heading owns what
    follows it up to the next heading of its level or a higher one; inside, other headings own nothing. group numbers runs of one owner.

    The open headings of all levels are a stack; level by level it is the last heading of the level, unless a higher one came since. So
    one sort by document gives them all."""
    text = F.regexp_replace(F.col(text_col), r"(?md)^(#{1,6}\s+.+)$", f"{CUT}$1")
    d = docs.where(F.col(text_col) != "").select(id_col, *keep, F.posexplode(F.split(text, CUT)).alias("segment", "text")).where("text != ''")
    level, title = F.length(F.regexp_extract("text", HEADING, 1)), F.regexp_extract("text", HEADING, 2)
    d = d.withColumn("level", F.nullif(level, F.lit(0))).withColumn("code", F.when(F.col("level").isNotNull(), heading_code(title)))
    known = codes.select("code", F.lit(True).alias("_known")).distinct()
    d = d.join(known, "code", "left").withColumn("code", F.when(F.col("_known"), F.col("code"))).drop("_known")
    w = Window.partitionBy(id_col).orderBy("segment")
    open_at = [F.last(F.when(F.col("level") <= k, F.struct((F.col("level") == k).alias("here"), "code", "segment")), ignorenulls=True).over(w) for k in range(1, 7)]
    d = d.withColumns({f"_open{k}": x for k, x in enumerate(open_at)})
    owners = [F.when(F.col(f"_open{k}.here") & F.col(f"_open{k}.code").isNotNull(), F.struct(F.col(f"_open{k}.code").alias("code"), F.col(f"_open{k}.segment").alias("segment"))) for k in range(6)]
    d = d.withColumn("_owner", F.coalesce(*owners)).drop(*(f"_open{k}" for k in range(6)))
    changed = ~F.col("_owner.segment").eqNullSafe(F.lag("_owner.segment").over(w)) | F.lag("segment").over(w).isNull()
    return d.withColumn("owner", F.col("_owner.code")).withColumn("group", F.sum(changed.cast("int")).over(w)).drop("_owner")


def line_owners(docs: DataFrame, id_col: str, text_col: str, codes: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows (id, *keep, line from 1, content, owner) of all lines that aren't empty, owner: the code of the issuer section that a line stands in."""
    s = _segments(docs, id_col, text_col, codes, keep)
    w = Window.partitionBy(id_col).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).over(w), F.lit(0))
    s = s.withColumn("_before", before)
    each = s.select(id_col, *keep, "owner", "_before", F.posexplode(F.split("text", "\n")).alias("_k", "content"))
    return each.where("content != ''").select(id_col, *keep, (F.col("_before") + F.col("_k") + 1).cast("int").alias("line"), "content", "owner")


def _blocks(gap: Column) -> Column:
    """Records of a text outside issuer sections, as (kind, content): cut after blank lines and before table rows; a block of more than
    LIST_SPLIT signs also before its list items, unless they stand in a code fence."""
    fence = r"(?msd)(^(`{3,})[^\n]*$(?:.*?^\2`*[^\S\n]*$|.*)|^(~{3,})[^\n]*$(?:.*?^\3~*[^\S\n]*$|.*))"
    parts = F.split(F.regexp_replace(gap, fence, f"{FENCE}$1{FENCE}"), FENCE)
    marked = F.array_join(F.transform(parts, lambda p, k: F.when(k % 2 == 0, F.regexp_replace(p, rf"(?<=\n)(?={ITEM})", ITEM_CUT)).otherwise(p)), "")
    cut = F.split(F.regexp_replace(marked, r"(\n\s*\n)|(?<=\n)(?=\|)", f"$1{CUT}"), CUT)
    plain = lambda x: F.replace(x, F.lit(ITEM_CUT), F.lit(""))
    whole = lambda b: F.array(F.struct(F.lit("context").alias("kind"), plain(b).alias("content")))

    def items(block: Column) -> Column:
        # The pieces of a block are bound once, so that a list costs in proportion to its items.
        kind = lambda p, n: F.when((n > 1) & p.rlike(rf"^(?:{ITEM})"), "list_item").otherwise("context")
        bound = F.array(F.filter(F.split(block, ITEM_CUT), lambda p: p != ""))
        return F.flatten(F.transform(bound, lambda pieces: F.transform(pieces, lambda p: F.struct(kind(p, F.size(pieces)).alias("kind"), p.alias("content")))))

    each = F.transform(F.filter(cut, lambda b: plain(b) != ""), lambda b: F.when(F.length(plain(b)) > LIST_SPLIT, items(b)).otherwise(whole(b)))
    return F.flatten(each)


def _markdown(docs: DataFrame, codes: DataFrame) -> DataFrame:
    s = _segments(docs, "doc", "text", codes, [])
    g = s.groupBy("doc", "group").agg(F.max("owner").alias("owner"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"]), "").alias("text"))
    section = F.array(F.struct(F.lit("issuer_section").alias("kind"), F.col("text").alias("content")))
    return g.select("doc", "group", F.posexplode(F.when(F.col("owner").isNotNull(), section).otherwise(_blocks(F.col("text")))).alias("place", "r")).select("doc", F.struct("group", "place").alias("place"), "r.kind", "r.content")


def csv_delimiter(text: str) -> str:
    """The one of , ; tab that the standard library's sniffer finds in the beginning, else in the first row, else a comma."""
    text = text.lstrip("\ufeff")
    for sample in (text[:65_536], text.split("\n", 1)[0]):
        try:
            return csv.Sniffer().sniff(sample, ",;\t").delimiter
        except csv.Error:
            continue
    return ","


def csv_rows(text: str) -> list[str]:
    """Rows of a CSV text with their line ends; joined they are the text. Only a quote at the beginning of a cell opens a quoted cell, in
    which line ends count for nothing and "" is one quote."""
    delimiter, out, begin, at, n = csv_delimiter(text), [], 0, 1 if text.startswith("\ufeff") else 0, len(text)
    cell = re.compile(rf'"(?:[^"]++|"")*+"?|[^{re.escape(delimiter)}\r\n]+')
    rest = re.compile(rf"[^{re.escape(delimiter)}\r\n]*")
    while at < n:
        if m := cell.match(text, at):
            at = rest.match(text, m.end()).end()
        if at < n and text[at] == delimiter:
            at += 1
        elif at < n:
            at += 2 if text.startswith("\r\n", at) else 1
            out.append(text[begin:at])
            begin = at
    return out + ([text[begin:]] if begin < n else [])


def _parsed(docs: DataFrame) -> DataFrame:
    """HTML and CSV documents: rows (doc, format, place, kind, content); what lies between the records of a page is a gap."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, kind, text in frame.itertuples(index=False):
                if kind == "csv":
                    rows += [(doc, kind, k, "row", r) for k, r in enumerate(csv_rows(text))]
                    continue
                cursor, place = 0, 0
                for a, b, tag in [*outermost(text), (len(text), len(text), "end")]:
                    for part, name in ((text[cursor:a], "gap"), (text[a:b], tag)):
                        if part:
                            rows.append((doc, kind, place, name, part))
                            place += 1
                    cursor = b
            yield pd.DataFrame(rows, columns=["doc", "format", "group", "kind", "content"])

    rows = docs.where(F.col("text") != "").select("doc", "kind", "text").mapInPandas(run, "doc string, format string, group int, kind string, content string")
    whole = F.array(F.struct("kind", "content"))
    blocks = F.transform(F.split(F.regexp_replace("content", r"(\n\s*\n)|(?<=\n)(?=\|)", f"$1{CUT}"), CUT), lambda b: F.struct(F.lit("context").alias("kind"), b.alias("content")))
    each = rows.select("doc", "format", "group", F.posexplode(F.when(F.col("kind") == "gap", F.filter(blocks, lambda b: b["content"] != "")).otherwise(whole)).alias("place", "r"))
    return each.select("doc", "format", F.struct("group", "place").alias("place"), "r.kind", "r.content")


def _pieces(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows (doc, format, place, kind, content) of documents; in order of place the contents of a document are its text."""
    d = docs.select(F.col("doc").cast("string").alias("doc"), "kind", F.col("text").cast("string").alias("text"))
    md = _markdown(d.where("kind = 'md'"), codes).withColumn("format", F.lit("md"))
    return md.unionByName(_parsed(d.where("kind in ('html', 'csv')")))


def _numbered(pieces: DataFrame) -> DataFrame:
    """Adds ordinal, line, start and end to pieces."""
    w = Window.partitionBy("doc").orderBy("place")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    start = F.coalesce(F.sum(F.length("content")).over(earlier), F.lit(0)).cast("bigint")
    out = pieces.withColumn("ordinal", F.row_number().over(w)).withColumn("line", (F.coalesce(F.sum(breaks).over(earlier), F.lit(0)) + 1).cast("int")).withColumn("start", start)
    return out.select("doc", "ordinal", "kind", "line", "start", (F.col("start") + F.length("content")).alias("end"), "content", "format", "place")


def partition_documents(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """Lossless records (doc, ordinal, kind, line, start, end, content) of documents (doc, kind md, html or csv, text): joined in order, the
    contents of a document are its text. Markdown: an issuer section is one record, kind issuer_section; the rest is cut after blank
    lines and before table rows, long blocks before list items. HTML: the outermost record elements, kind their name, and what lies
    between. CSV: one record a row, quoted line ends inside. line counts from 1, start and end in signs. A null or empty text has no
    record; documents need distinct names. Texts don't hold the noncharacters U+FDD1
    to U+FDD3."""
    return _numbered(_pieces(docs, codes)).drop("format", "place")


def annotate_documents(records: DataFrame, docs: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds to records of partition_documents: context (the open headings, outermost first, and the head of the table, a line each),
    codes (known ones written in capitals, sorted), event_date (a date that a table row begins with), dates (all ISO dates, sorted) and
    section_id (from content and place). The head of a table is its first row in Markdown, the last row with th in HTML, the first row in
    CSV; it ends with the table or at a heading."""
    r = records.join(docs.select(F.col("doc").cast("string").alias("doc"), F.col("kind").alias("format")), "doc")
    return _named(_annotated(r, "ordinal").drop("format"), records, codes, "ordinal")


def annotated_documents(docs: DataFrame, codes: DataFrame, named: bool = True) -> DataFrame:
    """annotate_documents of the records of partition_documents. Places and contexts come from one sort of the contents, and known codes
    from the records before it; without the column codes (named=False) documents are partitioned once."""
    pieces = _pieces(docs, codes)
    r = _annotated(_numbered(pieces), "place").drop("format")
    return (_named(r, pieces, codes, "place") if named else r).drop("place")


def _named(r: DataFrame, records: DataFrame, codes: DataFrame, place: str) -> DataFrame:
    """Adds to annotated records the known codes that stand in them. Few words are known, so they are held by key while contents pass."""
    words = records.select("doc", place, F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?U)\b([A-Z0-9]{2,8})\b"), F.lit(1)))).alias("code"))
    known = words.where(F.col("code").rlike("[A-Z]")).join(codes.select("code").distinct(), "code", "left_semi").groupBy("doc", place).agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return r.join(known.hint("shuffle_hash"), ["doc", place], "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def _annotated(r: DataFrame, place: str) -> DataFrame:
    """Adds all of annotate_documents but codes to records with their document's format, by windows in order of place alone."""
    md, html = F.col("format") == "md", F.col("format") == "html"
    tag = r"(?is)^<h([1-6])\b[^>]*>(.*?)</h\1>"
    level = F.when(md, F.nullif(F.length(F.regexp_extract("content", HEADING, 1)), F.lit(0))).when(html, F.regexp_extract("content", tag, 1).try_cast("int"))
    title = F.when(md, F.regexp_extract("content", HEADING, 2)).otherwise(F.regexp_extract("content", tag, 2))
    w = Window.partitionBy("doc").orderBy(place)
    r = r.withColumn("_level", level).withColumn("_title", title)
    chain = [F.last(F.when(F.col("_level") <= k, F.struct((F.col("_level") == k).alias("here"), "_title")), ignorenulls=True).over(w) for k in range(1, 7)]
    r = r.withColumns({f"_open{k}": x for k, x in enumerate(chain)})
    row, stripped = F.ltrim("content").startswith("|"), F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))
    ends = F.col("_level").isNotNull() | (md & (stripped != "") & ~row) | (html & F.lower("content").contains("</table"))
    # A table's head is the last that began since a table ended; in Markdown a row begins one if no row came since.
    in_table = F.last(F.when(md & row, True).when(ends, False), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_in_table", F.coalesce(in_table, F.lit(False)))
    begins = (md & row & ~F.col("_in_table")) | (html & (F.col("kind") == "tr") & F.col("content").rlike(r"(?i)<th\b"))
    head = F.last(F.when(begins, F.struct(stripped.alias("head"))).when(ends, F.struct(F.lit(None).cast("string").alias("head"))), ignorenulls=True).over(w)["head"]
    head = F.coalesce(head, F.when(F.col("format") == "csv", F.first(F.regexp_replace(stripped, "^\ufeff", "")).over(w)))
    head = F.when(html & ends, None).otherwise(head)
    opened = [F.when(F.col(f"_open{k}.here"), F.col(f"_open{k}._title")) for k in range(6)]
    plain = F.when(html, F.regexp_replace("content", "<[^>]+>", " ")).otherwise(F.col("content"))
    event = F.when((F.col("kind") == "tr") | row, F.nullif(F.regexp_extract(plain, r"^\s*\|?\s*(20\d{2}-\d{2}-\d{2})(?=[ T|\s]|$)", 1), F.lit("")))
    r = r.withColumn("context", F.array_join(F.array_compact(F.array(*opened, head)), "\n")).withColumn("event_date", event)
    r = r.withColumn("dates", F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\b(20\d{2}-\d{2}-\d{2})\b"), F.lit(1)))))
    return r.withColumn("section_id", F.concat(F.substring(F.sha2("content", 256), 1, 24), F.lit("-"), F.col("start"))).drop("_level", "_title", "_in_table", *(f"_open{k}" for k in range(6)))


def document_parts(records: DataFrame, docs: DataFrame, n: int = 22_000) -> DataFrame:
    """Rows (doc, part, start, end, line, section_id, context, content): documents cut every n signs, each part with its place and with
    section and context of the record that it begins in; joined in order, the parts of a document are its text. records: annotated. Which
    parts begin in a record follows from its place, so parts are made from records by a sequence, without a range join."""
    first = F.ceil(F.col("start") / n).cast("bigint") * n
    begun = records.where(first < F.col("end")).withColumn("at", F.explode(F.sequence(first, F.col("end") - 1, F.lit(n).cast("bigint"))))
    inside = F.substring("content", F.lit(1), (F.col("at") - F.col("start")).cast("int"))
    line = F.col("line") + F.length(inside) - F.length(F.replace(inside, F.lit("\n"), F.lit("")))
    begun = begun.select("doc", F.col("at").alias("start"), line.cast("int").alias("line"), "section_id", "context")
    text = docs.select(F.col("doc").cast("string").alias("doc"), "text")
    content = F.substring(F.col("text"), (F.col("start") + 1).cast("int"), F.lit(n))
    return begun.join(text, "doc").withColumn("content", content).select("doc", (F.floor(F.col("start") / n) + 1).cast("int").alias("part"), "start", (F.col("start") + F.length("content")).alias("end"), "line", "section_id", "context", "content")


def passages(records: DataFrame, n: int = 22_000, between: str = "\n…\n") -> DataFrame:
    """Rows (doc, passage, line, section_id, context, content): consecutive records of one context as one passage of at most n signs, so
    that a context is sent once. A record that is longer is cut every n signs; what is left out between two records (annotated, possibly
    a selection) shows as a mark. Packing depends on all that came before in the run, so it is state that streams over records in order
    of place: a partition holds whole documents, a task one record at a time."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / n).cast("int")), lambda k: F.substring(F.col("content"), k * n + 1, F.lit(n)))
    pieces = records.where("content != ''").select("doc", "ordinal", "start", "end", "line", "section_id", "context", F.posexplode(cut).alias("piece", "content"))
    gap = len(between)
    w = Window.partitionBy("doc").orderBy("ordinal", "piece")
    joins = (F.col("piece") == 0) & F.lag("context").over(w).eqNullSafe(F.col("context"))
    pieces = pieces.withColumn("_joins", F.coalesce(joins, F.lit(False))).withColumn("_gap", F.when(F.lag("end").over(w) == F.col("start"), 0).otherwise(gap)).withColumn("_size", F.length("content"))
    # The window has brought the pieces of a document into one partition in order.
    packed = with_packs(pieces, ["doc"], ["ordinal", "piece"], "_size", "_gap", "_joins", n, "passage", ordered=True)
    text = F.aggregate(F.array_sort(F.collect_list(F.struct("ordinal", "piece", "_gap", "content"))), F.lit(""), lambda s, x: F.when(s == "", x["content"]).otherwise(F.concat(s, F.when(x["_gap"] > 0, F.lit(between)).otherwise(F.lit("")), x["content"])))
    first = lambda c: F.min_by(c, F.struct("ordinal", "piece")).alias(c)
    return packed.groupBy("doc", "passage").agg(first("line"), first("section_id"), first("context"), text.alias("content"))
