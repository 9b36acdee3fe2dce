"""Registered queries on records, contexts, parts and mentions of documents that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.operators import digest as D
from filingflow.operators import mentions as M
from filingflow.operators import sections as S
from filingflow.plans.desk import EVENTS, PROSE, events, known
from filingflow.plans.registry import Registry
from filingflow.plans.tables import table

FILLER = "x" * 400
REPORTS = f"""{EVENTS},
report AS (SELECT doc_id, day, code, '# Daily ' || day || chr(10) || chr(10) AS r1, '{PROSE}' || chr(10) || chr(10) AS r2,
  '## ' || code || ' — PT ' || code || ' Tbk' || chr(10) || chr(10) || string_agg(line || chr(10), '' ORDER BY e) AS r3, '# Table' || chr(10) || chr(10) AS r4, '| date | event |' || chr(10) AS r5, '|---|---|' || chr(10) AS r6,
  string_agg('| ' || day || ' | ' || other || ' ' || e || ' |' || chr(10), '' ORDER BY e) || chr(10) AS rows, '# List' || chr(10) || chr(10) AS r8, string_agg('- item ' || e || ' {FILLER}' || chr(10), '' ORDER BY e) AS items, count(*) AS n
  FROM bullets GROUP BY doc_id, day, code),
records AS (SELECT r.doc_id, ordinal, kind, content, context, event_date FROM report r, unnest([
    {{'ordinal': 1, 'kind': 'context', 'content': r1, 'context': 'Daily ' || day, 'event_date': NULL}}, {{'ordinal': 2, 'kind': 'context', 'content': r2, 'context': 'Daily ' || day, 'event_date': NULL}},
    {{'ordinal': 3, 'kind': 'issuer_section', 'content': r3, 'context': 'Daily ' || day || chr(10) || code || ' — PT ' || code || ' Tbk', 'event_date': NULL}}, {{'ordinal': 4, 'kind': 'context', 'content': r4, 'context': 'Table', 'event_date': NULL}},
    {{'ordinal': 5, 'kind': 'context', 'content': r5, 'context': 'Table' || chr(10) || '| date | event |', 'event_date': NULL}}, {{'ordinal': 6, 'kind': 'context', 'content': r6, 'context': 'Table' || chr(10) || '| date | event |', 'event_date': NULL}},
    {{'ordinal': 7 + n, 'kind': 'context', 'content': r8, 'context': 'List', 'event_date': NULL}}]) AS u(x), LATERAL (SELECT x.ordinal, x.kind, x.content, x.context, x.event_date) AS v
  UNION ALL SELECT doc_id, 6 + k, 'context', '| ' || day || ' | ' || other || ' ' || e || ' |' || chr(10) || CASE WHEN k = n THEN chr(10) ELSE '' END, 'Table' || chr(10) || '| date | event |', CAST(day AS VARCHAR)
    FROM (SELECT b.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.e) AS k, n FROM bullets b JOIN report USING (doc_id))
  UNION ALL SELECT doc_id, 7 + n + k, 'list_item', '- item ' || e || ' {FILLER}' || chr(10), 'List', NULL
    FROM (SELECT b.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.e) AS k, n, items FROM bullets b JOIN report USING (doc_id)) WHERE length(items) > 1500
  UNION ALL SELECT doc_id, 8 + n, 'context', items, 'List', NULL FROM report WHERE length(items) <= 1500)"""
query = Registry(REPORTS)


def reports(spark, d) -> DataFrame:
    """Rows (doc, kind, text): a Markdown report for each user and day, with an issuer section, a table and a list of what happened."""
    e = events(spark, d)
    bullet = F.concat(F.lit("- ["), "kind", F.lit("] "), "text", F.lit(" — @user"), "u", F.lit(" "), F.date_format("ts", "HH:mm"), F.lit(" dari "), 1 + F.col("e") % 4, F.lit(" akun, "), F.col("e") % 3, F.lit(" balasan"), F.when(F.col("e") % 6 == 0, " gap").otherwise(""), F.lit(" ("), "fid", F.lit(")\n"))
    row = F.concat(F.lit("| "), F.col("day").cast("string"), F.lit(" | "), "other", F.lit(" "), "e", F.lit(" |\n"))
    item = F.concat(F.lit("- item "), "e", F.lit(f" {FILLER}\n"))
    g = e.groupBy("doc_id", "day", "code").agg(F.array_sort(F.collect_list(F.struct("e", bullet.alias("bullet"), row.alias("row"), item.alias("item")))).alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda v: v[c]), "")
    head = F.concat(F.lit("# Daily "), F.col("day").cast("string"), F.lit(f"\n\n{PROSE}\n\n## "), "code", F.lit(" — PT "), "code", F.lit(" Tbk\n\n"))
    text = F.concat(head, joined("bullet"), F.lit("# Table\n\n| date | event |\n|---|---|\n"), joined("row"), F.lit("\n# List\n\n"), joined("item"))
    return g.select(F.col("doc_id").cast("string").alias("doc"), F.lit("md").alias("kind"), text.alias("text"))


def _records(spark, d) -> DataFrame:
    return S.partition_documents(reports(spark, d), known(spark, d))


@query("R01_partition_records", "SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(ordinal AS INTEGER) AS ordinal, kind, content FROM records")
def r01(spark, d):
    return _records(spark, d).select("doc", "ordinal", "kind", "content")


@query("R02_annotate_records", """, named AS (SELECT doc_id, ordinal, string_agg(c, ',' ORDER BY c) AS codes FROM (SELECT DISTINCT doc_id, ordinal, unnest(regexp_extract_all(content, '\\b[A-Z]{4}\\b')) AS c FROM records) WHERE c IN (SELECT code FROM known) GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(ordinal AS INTEGER) AS ordinal, context, event_date, substr(sha256(content), 1, 24) AS digest, coalesce(codes, '') AS codes FROM records LEFT JOIN named USING (doc_id, ordinal)""")
def r02(spark, d):
    docs = reports(spark, d)
    r = S.annotated_documents(docs, known(spark, d))
    return r.select("doc", "ordinal", "context", "event_date", F.substring("section_id", 1, 24).alias("digest"), F.array_join("codes", ",").alias("codes"))


@query("R03_check_lossless", """SELECT 'd' || doc_id AS doc, sha256(text) AS sha256, true AS lossless FROM documents WHERE text <> '' UNION ALL SELECT 'p' || page_id, sha256(html), true FROM pages WHERE html <> ''
UNION ALL SELECT 'c' || c_nationkey, sha256(chr(65279) || 'key;"the name"' || chr(10) || string_agg(c_custkey || ';"' || c_name || chr(10) || 'of ""' || c_mktsegment || repeat(chr(34), 3) || chr(13) || chr(10), '' ORDER BY c_custkey)), true FROM customer GROUP BY c_nationkey""")
def r03(spark, d):
    """Texts of all documents as Markdown, all pages as HTML, and customers of a nation as CSV with quoted line ends."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.concat("c_custkey", F.lit(';"'), "c_name", F.lit('\nof ""'), "c_mktsegment", F.lit('"""\r\n')).alias("row")))).alias("x"))
    csv = c.select(F.concat(F.lit("c"), "c_nationkey").alias("doc"), F.lit("csv").alias("kind"), F.concat(F.lit('﻿key;"the name"\n'), F.array_join(F.transform("x", lambda v: v["row"]), "")).alias("text"))
    md = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc"), F.lit("md").alias("kind"), "text")
    html = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("doc"), F.lit("html").alias("kind"), F.col("html").alias("text"))
    docs = md.unionByName(html).unionByName(csv)
    records = S.partition_documents(docs, known(spark, d))
    joined = records.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "").alias("joined"))
    return joined.join(docs, "doc").select("doc", F.sha2("joined", 256).alias("sha256"), (F.col("joined") == F.col("text")).alias("lossless"))


@query("R11_chunk_text", """, t AS (SELECT CAST(doc_id AS VARCHAR) AS doc, r1 || r2 || r3 || r4 || r5 || r6 || rows || r8 || items AS text FROM report),
placed AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM records)
SELECT doc, CAST(k + 1 AS INTEGER) AS part, CAST(k * 500 AS BIGINT) AS "start", CAST(1 + length(substr(text, 1, CAST(k * 500 AS BIGINT))) - length(replace(substr(text, 1, CAST(k * 500 AS BIGINT)), chr(10), '')) AS INTEGER) AS line,
  substr(text, CAST(k * 500 + 1 AS BIGINT), 500) AS content, p.context FROM t, unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) u(k) JOIN placed p ON CAST(p.doc_id AS VARCHAR) = doc AND k * 500 >= a AND k * 500 < a + length(p.content)""")
def r11(spark, d):
    docs = reports(spark, d)
    r = S.annotated_documents(docs, known(spark, d), named=False)
    return S.document_parts(r, docs, 500).select("doc", "part", "start", "line", "content", "context")


@query("R11_passages")
def r11_passages(spark, d):
    docs = reports(spark, d)
    r = S.annotated_documents(docs, known(spark, d), named=False)
    return S.passages(r, 2000).select("doc", "passage", "line", "section_id", "context", "content")


FILES = """, child AS (SELECT b.*, row_number() OVER (PARTITION BY doc_id ORDER BY e) AS k, '### ' || other || ' — E' || chr(10) || '- ' || text || chr(10) AS body, other IN (SELECT code FROM known) AS is_known FROM bullets b),
file AS (SELECT doc_id, day, code, u, any_value(is_known) AS is_known, count(*) AS n, string_agg(line || chr(10), '' ORDER BY e) AS bullets, string_agg(body, '' ORDER BY e) AS bodies FROM child GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) AS doc, place, kind, code, tier, parent, CAST(strlen(text) AS INTEGER) AS size FROM (
  SELECT doc_id, 1 AS place, 'pre' AS kind, NULL AS code, NULL AS tier, NULL AS parent, '# Daily ' || day || chr(10) || chr(10) AS text FROM file
  UNION ALL SELECT doc_id, 2, 'head', NULL, NULL, NULL, '## Sorotan' || chr(10) || 'hot' || chr(10) FROM file
  UNION ALL SELECT doc_id, 3, 'issuer', code, 1, NULL, '## ' || code || ' — PT ' || code || ' Tbk' || chr(10) || chr(10) || bullets FROM file WHERE u % 2 = 0
  UNION ALL SELECT doc_id, 4 - u % 2, CASE WHEN is_known THEN 'intro' ELSE 'aux' END, NULL, NULL, NULL, '## Emiten lain' || chr(10) || 'opening' || chr(10) || CASE WHEN is_known THEN '' ELSE bodies END FROM file
  UNION ALL SELECT doc_id, 4 - u % 2 + k, 'issuer', other, 2 - u % 2, 4 - u % 2, body FROM child WHERE is_known
  UNION ALL SELECT doc_id, 5 - u % 2 + CASE WHEN is_known THEN n ELSE 0 END, 'appendix', NULL, NULL, NULL, '## Lampiran: semua' || chr(10) || '- a' || chr(10) FROM file)"""


def _segments(spark, d) -> DataFrame:
    """Segments of a file for each user and day; every other user's has a section of its own before the container of others."""
    e = events(spark, d)
    bullet = F.concat(F.lit("- ["), "kind", F.lit("] "), "text", F.lit(" — @user"), "u", F.lit(" "), F.date_format("ts", "HH:mm"), F.lit(" dari "), 1 + F.col("e") % 4, F.lit(" akun, "), F.col("e") % 3, F.lit(" balasan"), F.when(F.col("e") % 6 == 0, " gap").otherwise(""), F.lit(" ("), "fid", F.lit(")\n"))
    body = F.concat(F.lit("### "), "other", F.lit(" — E\n- "), "text", F.lit("\n"))
    g = e.groupBy("doc_id", "day", "code", "u").agg(F.array_sort(F.collect_list(F.struct("e", bullet.alias("bullet"), body.alias("body")))).alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda v: v[c]), "")
    own = F.when(F.col("u") % 2 == 0, F.concat(F.lit("## "), "code", F.lit(" — PT "), "code", F.lit(" Tbk\n\n"), joined("bullet"))).otherwise("")
    text = F.concat(F.lit("# Daily "), F.col("day").cast("string"), F.lit("\n\n## Sorotan\nhot\n"), own, F.lit("## Emiten lain\nopening\n"), joined("body"), F.lit("## Lampiran: semua\n- a\n"))
    return D.daily_segments(g.select(F.col("doc_id").cast("string").alias("doc"), text.alias("text")), known(spark, d))


@query("R04_segment_daily", FILES)
def r04(spark, d):
    return D.sized(_segments(spark, d)).select("doc", "place", "kind", "code", "tier", "parent", "size")


@query("B04_digest_plan")
def b04(spark, d):
    """Each user asks for all of their days; summaries of even days are read beside their details."""
    days = events(spark, d).select(F.col("doc_id").cast("string").alias("doc"), F.col("u").alias("request"), "day").distinct()
    s = D.sized(_segments(spark, d)).join(days, "doc").withColumn("cat", F.lit("bei")).withColumn("head_only", F.dayofmonth("day") % 2 == 0)
    return D.digest_plan(s, 2500)


MENTIONS = """, said AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e) + 4 AS line, CASE WHEN u % 3 = 0 THEN 'keterbukaan-informasi' ELSE 'bei-detail' END AS cat, e % 8 AS k FROM ev),
found AS (SELECT other AS code, day AS date, code AS filer, CAST(doc_id AS VARCHAR) AS doc, CAST(line AS INTEGER) AS line,
  CASE k WHEN 0 THEN 'lain' WHEN 1 THEN 'lain' WHEN 2 THEN 'kreditur' WHEN 5 THEN 'transaksi_saham' END AS relation,
  CASE k WHEN 0 THEN 'Induk PT Maju Tbk (' || other || ') hadir ' || e || '.' WHEN 1 THEN 'harga saham ' || lower(other) || ' naik ' || e WHEN 2 THEN other || ' menerima pinjaman ' || e ELSE 'Karya n' || (u + 1) || ' menjual saham ' || e END AS snippet
  FROM said WHERE k IN (0, 1) OR (k = 2 AND cat = 'bei-detail') OR (k = 5 AND u + 1 IN (SELECT u FROM ev)))
SELECT * FROM found WHERE code IN (SELECT code FROM known)"""


@query("C05_scan_mentions", MENTIONS)
def c05(spark, d):
    e = events(spark, d).withColumn("k", F.col("e") % 8)
    n, lit = F.col("u") + 1, F.lit
    said = F.when(F.col("k") == 0, F.concat(lit("Induk PT Maju Tbk ("), "other", lit(") hadir "), "e", lit(". Lalu selesai."))).when(F.col("k") == 1, F.concat(lit("harga saham "), F.lower("other"), lit(" naik "), "e"))
    said = said.when(F.col("k") == 2, F.concat("other", lit(" menerima pinjaman "), "e")).when(F.col("k") == 3, F.concat("other", lit(" menerima tamu "), "e")).when(F.col("k") == 4, F.concat(lit("Karya n"), n, lit(" Beton menjual saham "), "e"))
    said = said.when(F.col("k") == 5, F.concat(lit("Karya n"), n, lit(" menjual saham "), "e")).when(F.col("k") == 6, F.concat(lit("- Lampiran Tbk ("), "other", lit(") "), "e")).otherwise(F.concat(lit("[teks]("), "other", lit(") saham_"), F.lower("other"), lit(" @"), F.lower("other"), lit(" "), "e"))
    g = e.withColumn("said", said).groupBy("doc_id", "day", "code", "u").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "said"))), lambda x: x["said"]), "\n").alias("body"))
    head = F.concat(lit("# Daily\n\n## "), "code", lit(" — PT "), "code", lit(" Tbk\n\n"), "body", lit("\n"))
    docs = g.select(F.col("doc_id").cast("string").alias("doc"), F.when(F.col("u") % 3 == 0, "keterbukaan-informasi").otherwise("bei-detail").alias("cat"), F.col("day").alias("date"), head.alias("text"))
    own = e.select("code", "u").distinct()
    names = own.select("code", F.concat(lit("PT Karya n"), "u", lit(" Tbk")).alias("name")).unionByName(own.select("code", F.concat(lit("PT Karya n"), n, lit(" Beton Tbk")).alias("name")))
    return M.scan_mentions(docs, known(spark, d), names).select("code", "date", "filer", "doc", "line", "relation", "snippet")


QUERIES, SQL = query.queries, query.sql
