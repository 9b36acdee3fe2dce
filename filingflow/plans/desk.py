"""Registered queries on daily files, claims, records, names and reports that Spark derives from the driver's event, part and order
tables, with DuckDB SQL that says what each operator must find from the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.functions import text as T
from filingflow.operators import audit as V
from filingflow.operators import budget as B
from filingflow.operators import claims as C
from filingflow.operators import mentions as M
from filingflow.operators import records as R
from filingflow.operators import search as X
from filingflow.operators.verdicts import topic_bits
from filingflow.plans.registry import Registry
from filingflow.plans.tables import table

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def code_sql(x: str) -> str:
    """A code of four capitals for a number."""
    return "'Q' || " + " || ".join(f"substr('{LETTERS}', (({x}) // {k}) % 26 + 1, 1)" for k in (676, 26, 1))


def code(x) -> F.Column:
    letter = lambda k: F.substring(F.lit(LETTERS), (F.floor(x / k) % 26 + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("Q"), letter(676), letter(26), letter(1))


PROSE = "A line of prose that is long enough to say what this day was about."
EVENTS = f"""ev AS (SELECT *, CASE e % 5 WHEN 0 THEN t || ' cash dividend of the year' WHEN 1 THEN t || ' tidak ada rights issue planned says user' || (u + 2) WHEN 2 THEN t || ' buyback and merger with ' || other WHEN 3 THEN t || ' loan pinjaman from lender ' || CASE WHEN e % 2 = 1 THEN other ELSE code END ELSE t || ' PT Maju' || (e % 3) || ' Tbk (' || other || ') akuisisi saham' END AS text
  FROM (SELECT event_id AS e, user_id AS u, CAST(ts AS DATE) AS day, ts, event_type AS t, user_id * 100 + day(ts) AS doc_id, {code_sql('user_id')} AS code, {code_sql('user_id + 1')} AS other, CASE event_type WHEN 'purchase' THEN 'R' WHEN 'error' THEN 'K' ELSE 'M' END AS kind, 'F' || event_id AS fid FROM events)),
bullets AS (SELECT *, '- [' || kind || '] ' || text || ' — @user' || u || ' ' || strftime(ts, '%H:%M') || ' dari ' || (1 + e % 4) || ' akun, ' || (e % 3) || ' balasan' || CASE WHEN e % 6 = 0 THEN ' gap' ELSE '' END || ' (' || fid || ')' AS line FROM ev),
known AS (SELECT DISTINCT code FROM ev),
heads AS (SELECT DISTINCT doc_id, day, code, '# Daily ' || day || chr(10) || chr(10) || '{PROSE}' || chr(10) || chr(10) AS head, '## ' || code || ' — PT ' || code || ' Tbk' || chr(10) || chr(10) AS title FROM ev)"""

query = Registry(EVENTS)
plain = Registry()


def events(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("t"))
    e = e.withColumn("doc_id", F.col("u") * 100 + F.dayofmonth("day")).withColumn("code", code(F.col("u"))).withColumn("other", code(F.col("u") + 1))
    e = e.withColumn("kind", F.when(F.col("t") == "purchase", "R").when(F.col("t") == "error", "K").otherwise("M")).withColumn("fid", F.concat(F.lit("F"), "e"))
    k = F.col("e") % 5
    said = F.when(k == 0, " cash dividend of the year").when(k == 1, F.concat(F.lit(" tidak ada rights issue planned says user"), F.col("u") + 2)).when(k == 2, F.concat(F.lit(" buyback and merger with "), "other"))
    said = said.when(k == 3, F.concat(F.lit(" loan pinjaman from lender "), F.when(F.col("e") % 2 == 1, F.col("other")).otherwise(F.col("code")))).otherwise(F.concat(F.lit(" PT Maju"), F.col("e") % 3, F.lit(" Tbk ("), "other", F.lit(") akuisisi saham")))
    return e.withColumn("text", F.concat("t", said))


def daily(spark, d) -> DataFrame:
    """Rows (doc_id, date, code, text): a Markdown file for each user and day; a user's day is bounded, however many there are."""
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), "text", F.lit(" — @user"), "u", F.lit(" "), F.date_format("ts", "HH:mm"), F.lit(" dari "), 1 + F.col("e") % 4, F.lit(" akun, "), F.col("e") % 3, F.lit(" balasan"), F.when(F.col("e") % 6 == 0, " gap").otherwise(""), F.lit(" ("), "fid", F.lit(")"))
    g = events(spark, d).withColumn("line", line).groupBy("doc_id", "day", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return g.select("doc_id", F.col("day").alias("date"), "code", F.concat(F.lit("# Daily "), F.col("day").cast("string"), F.lit(f"\n\n{PROSE}\n\n## "), "code", F.lit(" — PT "), "code", F.lit(" Tbk\n\n"), "body", F.lit("\n")).alias("text"))


def claims(spark, d) -> DataFrame:
    return C.parse_claims(daily(spark, d), "doc_id", "text", "date")


def records(spark, d) -> DataFrame:
    """Claims as records (doc_id, ordinal, code, content)."""
    return events(spark, d).select("doc_id", F.col("e").alias("ordinal"), "code", F.col("text").alias("content"))


def known(spark, d) -> DataFrame:
    return table(spark, d, "events").select(code(F.col("user_id")).alias("code")).distinct()


@query("T02_md_info", f"SELECT doc_id, 'Daily ' || day AS title, CAST(2 AS INTEGER) AS level, CAST(1 AS BIGINT) AS headings, '{PROSE}' AS description FROM heads")
def t02(spark, d):
    return R.md_info(daily(spark, d), "doc_id", "text").withColumn("headings", F.col("headings").cast("bigint"))


@plain("T07_strip_refs", "SELECT event_id, 'see ' || event_type || ' and more' AS text FROM events")
def t07(spark, d):
    written = F.concat(F.lit("see ["), "event_type", F.lit("](http://x.example/"), "event_id", F.lit(")  (F"), "event_id", F.lit(", F1) and https://y.example/a?b=1 more (F2)"))
    return table(spark, d, "events").select("event_id", T.strip_refs(written).alias("text"))


@plain("T08_format_local", "SELECT o_orderkey, translate(format('{:,.2f}', CAST(o_orderkey AS DOUBLE) * 1234.5), ',.', '.,') AS written FROM orders")
def t08(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.format_local(F.col("o_orderkey") * 1234.5, 2).alias("written"))


@plain("S10_parse_local", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN o_orderkey + 0.5 WHEN 2 THEN 1000000.0 + o_orderkey % 1000 WHEN 3 THEN o_orderkey % 1000 + 5000.25 ELSE CAST(o_orderkey % 90 AS DOUBLE) END AS value FROM orders")
def s10(spark, d):
    k, three = F.col("o_orderkey"), lambda x: F.lpad(x.cast("string"), 3, "0")
    forms = F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, F.concat(k, F.lit(",5"))).when(k % 6 == 2, F.concat(F.lit("1,000,"), three(k % 1000))).when(k % 6 == 3, F.concat(F.lit("5."), three(k % 1000), F.lit(",25"))).when(k % 6 == 4, F.concat(k % 90, F.lit("%"))).otherwise("n/a")
    return table(spark, d, "orders").select("o_orderkey", T.parse_local(forms).alias("value"))


@query("R05_section_facts", "SELECT doc_id, code, arg_min(line, e) FILTER (t = 'purchase') AS bought, arg_min(line, e) FILTER (t = 'error') AS failed FROM bullets GROUP BY ALL")
def r05(spark, d):
    return R.section_facts(daily(spark, d), "doc_id", "text", {"bought": r"\] purchase", "failed": r"\] error"})


def _schedules(spark, d):
    line = F.concat(F.to_date("ts").cast("string"), F.lit(": "), "event_type", F.lit(" number "), "event_id")
    e = table(spark, d, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("doc_id"), F.struct("event_id", line.alias("line")).alias("x"))
    return e.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


@query("R06_extract_schedule", "SELECT doc_id, CAST(day AS VARCHAR) AS date, t || ' number ' || e AS event FROM ev WHERE doc_id IN (SELECT doc_id FROM ev GROUP BY 1 HAVING count(*) >= 3)")
def r06(spark, d):
    return R.extract_schedule(_schedules(spark, d), "doc_id", "text").select("doc_id", "date", "event")


@query("R07_tag_sentences", "SELECT doc_id, CAST(day AS VARCHAR) || ': ' || t || ' number ' || e AS sentence, CASE t WHEN 'error' THEN 'failed' ELSE 'bought' END AS tag FROM ev WHERE t IN ('error', 'purchase')")
def r07(spark, d):
    return R.tag_sentences(_schedules(spark, d), "doc_id", "text", [("failed", r"\berror\b"), ("bought", r"\bpurchase\b")]).select("doc_id", "sentence", "tag")


@query("R08_best_passage", "SELECT doc_id, CAST(4 AS INTEGER) AS first, CAST(5 + count(*) AS INTEGER) AS last, CAST(sum(CASE WHEN e % 5 IN (0, 2, 3) THEN 1 ELSE 0 END) AS BIGINT) AS score FROM ev GROUP BY 1 HAVING bool_or(e % 5 = 2) AND sum(CASE WHEN e % 5 IN (0, 2, 3) THEN 1 ELSE 0 END) >= 2")
def r08(spark, d):
    found = R.best_passage(R.lines(daily(spark, d), "doc_id", "text"), "doc_id", "merger", ["merger", "dividend", "loan"], 2)
    return found.select("doc_id", "first", "last", F.col("score").cast("bigint").alias("score"))


@query("R09_document_facts", "SELECT doc_id, day AS event_date, count(DISTINCT e) AS rows, CAST(count(DISTINCT c) AS INTEGER) AS codes FROM (SELECT doc_id, day, e, unnest([code, CASE WHEN e % 2 = 0 THEN other ELSE code END]) AS c FROM ev) GROUP BY ALL")
def r09(spark, d):
    r = events(spark, d).select("doc_id", F.col("day").alias("event_date"), F.array("code", F.when(F.col("e") % 2 == 0, F.col("other")).otherwise(F.col("code"))).alias("codes"))
    return R.document_facts(r, "doc_id")


@query("R10_outline", "SELECT doc_id, CAST(k AS INTEGER) AS line, CAST(strlen('# Daily ' || day) + 1 + CASE WHEN k >= 1 THEN 1 ELSE 0 END + CASE WHEN k >= 2 THEN strlen('" + PROSE + "') + 1 ELSE 0 END + CASE WHEN k >= 3 THEN 1 ELSE 0 END + CASE WHEN k >= 4 THEN strlen(title) - 1 ELSE 0 END AS BIGINT) AS bytes FROM heads, range(5) r(k)")
def r10(spark, d):
    return R.outline(R.lines(daily(spark, d), "doc_id", "text"), "doc_id", 4000).select("doc_id", "line", F.col("bytes").cast("bigint").alias("bytes"))


@query("X05_expand_links", "SELECT DISTINCT a.doc_id, a.e AS ordinal FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.e % 7 = b.e % 5 AND b.e % 3 = 0")
def x05(spark, d):
    r = events(spark, d).select("doc_id", F.col("e").alias("ordinal"), F.concat(F.lit('<p id="a'), F.col("e") % 7, F.lit('">see <a href="#a'), F.col("e") % 5, F.lit('">there</a></p>')).alias("content"))
    return X.expand_links(r, r.where("ordinal % 3 = 0"), "doc_id")


@query("X06_prune_comentions", "SELECT doc_id, e AS line FROM ev WHERE code <> 'QAAB' AND contains(text, 'QAAB') AND text NOT IN (SELECT text FROM ev WHERE code = 'QAAB')")
def x06(spark, d):
    lines = records(spark, d).withColumnRenamed("ordinal", "line")
    return X.prune_comentions(lines, "QAAB").select("doc_id", "line")


@query("X07_trim_lists", "SELECT doc_id, 6 + count(*) FILTER (e % 5 = 0) AS kept, count(*) FILTER (e % 5 <> 0) AS dropped FROM ev GROUP BY 1")
def x07(spark, d):
    return R.trim_lists(R.lines(daily(spark, d), "doc_id", "text"), "doc_id", F.col("content").contains("dividend"))


@query("X08_thematic_passages", "SELECT doc_id, ordinal, hit FROM (SELECT doc_id, e AS ordinal, e % 5 IN (2, 3) AS hit, coalesce(lag(e % 5 IN (2, 3)) OVER w, false) OR coalesce(lead(e % 5 IN (2, 3)) OVER w, false) AS near FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY e)) WHERE hit OR near")
def x08(spark, d):
    return X.thematic_passages(records(spark, d), "doc_id", r"\bQ[A-Z]{3}\b", r"\b(merger|loan)\b")


@query("X11_detect_codes", "SELECT DISTINCT e, code FROM (SELECT e, CASE WHEN e % 5 = 3 AND e % 2 = 0 THEN code ELSE other END AS code FROM ev WHERE e % 5 IN (2, 3, 4) UNION ALL SELECT e, code FROM ev WHERE e % 4 = 0 OR (e % 4 = 1 AND u % 2 = 1)) WHERE code IN (SELECT code FROM known)")
def x11(spark, d):
    e = events(spark, d)
    lower = F.when(F.col("e") % 4 == 0, F.concat(F.lit(" ticker "), F.lower("code"))).when(F.col("e") % 4 == 1, F.concat(F.lit(" like "), F.lower("code"))).otherwise("")
    codes = table(spark, d, "events").select(code(F.col("user_id")).alias("code"), (F.col("user_id") % 2 == 0).alias("wordlike")).distinct()
    return X.detect_codes(e.select("e", F.concat("text", lower).alias("text")), "e", "text", codes, ["ticker"])


@query("X13_codes_by_handle", "SELECT handle, code, n, docs FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY n DESC, docs DESC, code) AS k FROM (SELECT u % 20 AS handle, c AS code, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT u, doc_id, unnest([code, other]) AS c FROM ev) GROUP BY ALL)) WHERE k <= 12")
def x13(spark, d):
    return X.codes_by_handle(events(spark, d).select((F.col("u") % 20).alias("handle"), "doc_id", F.col("e").alias("ordinal"), F.array("code", "other").alias("codes")), "doc_id")


@query("X15_overview", "SELECT c AS code, count(DISTINCT doc_id) AS docs, max(day) AS last FROM (SELECT doc_id, day, unnest([code, other]) AS c FROM ev) GROUP BY 1")
def x15(spark, d):
    return X.overview(events(spark, d).select("doc_id", "day", F.array("code", "other").alias("codes")), "doc_id", "day")


@query("X16_detect_handles", "SELECT DISTINCT doc_id, 'user' || h AS handle FROM (SELECT doc_id, u AS h FROM ev UNION ALL SELECT doc_id, u + 2 FROM ev WHERE e % 5 = 1) WHERE h % 2 = 0 AND h IN (SELECT u FROM ev)")
def x16(spark, d):
    handles = table(spark, d, "events").where("user_id % 2 = 0").select(F.concat(F.lit("user"), "user_id").alias("handle")).distinct()
    return X.detect_handles(daily(spark, d), "doc_id", "text", handles).select("doc_id", "handle")


TYPES = "types AS (SELECT *, CASE e % 5 WHEN 0 THEN ['dividend'] WHEN 2 THEN ['buyback', 'merger'] WHEN 4 THEN ['acquisition'] ELSE [] END AS types FROM ev)"


@query("N02_classify_actions", f", {TYPES} SELECT e, array_to_string(types, ',') AS types FROM types")
def n02(spark, d):
    return C.classify_actions(events(spark, d).select("e", "text"), "text").select("e", F.array_join("types", ",").alias("types"))


@query("N03_digest_events", f", {TYPES} SELECT t.doc_id, t.code, substr(line, 3) AS text, unnest(types) AS type FROM types t JOIN bullets USING (e)")
def n03(spark, d):
    return C.digest_events(daily(spark, d), "doc_id", "text", "Tbk$").select("doc_id", "code", "text", "type")


TEXT_EVENTS = TYPES + ", text_events AS (SELECT doc_id, e AS ordinal, CASE WHEN e % 5 = 2 AND other IN (SELECT code FROM known) THEN other ELSE code END AS code, text, unnest(types) AS type FROM types)"


def _text_events(spark, d):
    return C.text_events(records(spark, d), "doc_id", known(spark, d)).drop("place")


@query("N04_text_events", f", {TEXT_EVENTS} SELECT * FROM text_events")
def n04(spark, d):
    return _text_events(spark, d)


@query("N05_dedupe_events", f", {TEXT_EVENTS} SELECT code, type, min(ordinal) AS ordinal FROM text_events GROUP BY ALL")
def n05(spark, d):
    return C.dedupe_events(_text_events(spark, d), ["code", "type"], [F.asc("ordinal")]).select("code", "type", "ordinal")


@query("N06_entity_names", "SELECT code, name, n, row_number() OVER (PARTITION BY code ORDER BY n DESC, name) = 1 AS \"primary\" FROM (SELECT other AS code, 'PT Maju' || (e % 3) || ' Tbk' AS name, count(*) AS n FROM ev WHERE e % 5 = 4 GROUP BY ALL)")
def n06(spark, d):
    return C.entity_names(events(spark, d), "text")


@query("N07_ambiguous_codes", "SELECT code FROM known WHERE substr(code, 4, 1) IN ('A', 'E', 'I')")
def n07(spark, d):
    return C.ambiguous_codes(known(spark, d), [("vowel", "A$"), ("other", "^Q..[EI]$")])


SCREENED = "screened AS (SELECT u % 50 AS entity, t AS type, day AS date, (['digest', 'ki', 'bei', 'stockbit', 'other'])[CAST(e % 5 AS INTEGER) + 1] AS kind, 'text ' || e % 7 AS text, CAST(e % 5 < 3 AS INTEGER) AS official FROM ev WHERE t IN ('error', 'purchase') AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')"


@query("N08_screen", f""", {SCREENED}, once AS (SELECT * FROM screened QUALIFY row_number() OVER (PARTITION BY entity, text ORDER BY official DESC, date DESC, kind) = 1), items AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY entity ORDER BY official DESC, date DESC, text) <= 3)
SELECT s.entity, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT type AS x FROM screened i WHERE i.entity = s.entity)) AS types, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT kind AS x FROM screened i WHERE i.entity = s.entity)) AS kinds, max(date) AS last, max(official) AS official, count(*) AS n, (SELECT string_agg(text, '|' ORDER BY text) FROM items i WHERE i.entity = s.entity) AS items FROM screened s GROUP BY s.entity""")
def n08(spark, d):
    kinds = F.array(*map(F.lit, ["digest", "ki", "bei", "stockbit", "other"]))
    e = events(spark, d).select((F.col("u") % 50).alias("entity"), F.col("t").alias("type"), F.col("day").alias("date"), F.get(kinds, (F.col("e") % 5).cast("int")).alias("kind"), F.concat(F.lit("text "), F.col("e") % 7).alias("text"))
    return C.screen(e, ["error", "purchase"], "2024-01-05", "2024-01-20")


@query("N09_query_types", f", {TYPES} SELECT e, unnest(CASE WHEN e % 5 = 1 THEN ['rights_issue'] ELSE types END) AS type FROM types")
def n09(spark, d):
    return C.query_types(events(spark, d), "e", "text")


CLAIMS = "claims AS (SELECT doc_id, fid, kind, text, 'user' || u AS handle, strftime(ts, '%H:%M') AS time, CAST(1 + e % 4 AS INTEGER) AS accounts, e % 6 = 0 AS gap, CAST(e % 3 AS INTEGER) AS replies, code, day AS date, e, other FROM ev)"


@query("C01_parse_claims", f", {CLAIMS} SELECT * EXCLUDE (e, other) FROM claims")
def c01(spark, d):
    return claims(spark, d).drop("line")


@query("C02_cross_entity_claims", f", {CLAIMS} SELECT fid, text, unnest([code, other]) AS code FROM claims")
def c02(spark, d):
    line = F.concat(F.lit("## Lintas emiten\n\n- ["), "kind", F.lit("] "), "code", F.lit(", "), "other", F.lit(": "), "text", F.lit(" — @user"), "u", F.lit(" "), F.date_format("ts", "HH:mm"), F.lit(" ("), "fid", F.lit(")"))
    docs = events(spark, d).select(F.col("e").alias("doc_id"), F.col("day").alias("date"), line.alias("text"))
    return C.parse_claims(docs, "doc_id", "text", "date").select("fid", "text", "code")


@query("C06_relation_class", "SELECT e, CASE e % 5 WHEN 3 THEN 'kreditur' WHEN 4 THEN 'transaksi_saham' ELSE 'lain' END AS relation FROM ev")
def c06(spark, d):
    return events(spark, d).select("e", M.relation_of(F.col("text")).alias("relation"))


@plain("C07_name_keys", "SELECT s_suppkey AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' abadi' END AS key FROM supplier WHERE s_suppkey % 2 = 0")
def c07(spark, d):
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("PT. "), "s_name", F.lit(" Abadi, Tbk"))).otherwise(F.concat(F.lit("PT Ab"), F.col("s_suppkey") % 9, F.lit(" Tbk")))
    return C.name_keys(table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), name.alias("name"))).select("code", "key")


MARKED = "substr('ABCDEFG', CAST(e % 7 + 1 AS BIGINT), 1) || 'x'"


def _marked():
    return F.concat(F.substring(F.lit("ABCDEFG"), (F.col("e") % 7 + 1).cast("int"), F.lit(1)), F.lit("x"))


@query("C08_role_mentions", f"""SELECT e, (['direktur utama', 'pembeli', 'penjual', 'BAE'])[CAST(e % 4 + 1 AS BIGINT)] AS role, CASE e % 4 WHEN 0 THEN 'Budi Santoso' || {MARKED} WHEN 3 THEN 'PT Adimitra ' || {MARKED} || ' Transferindo' ELSE 'PT Maju ' || {MARKED} || ' Jaya' END AS name, CASE WHEN e % 4 = 0 THEN 'person' ELSE 'firm' END AS kind FROM ev WHERE e % 5 <> 4""")
def c08(spark, d):
    e, x, lit = F.col("e"), _marked(), F.lit
    said = F.when(e % 5 == 4, "menurut Direktur Keuangan Kepatuhan dan Pembeli Utama Lama").when(e % 4 == 0, F.concat(lit("menurut Direktur Utama baru Ir. Budi Santoso"), x, lit(" Tbk."))).when(e % 4 == 1, F.concat(lit("oleh Pembeli: PT Maju "), x, lit(" Jaya.")))
    said = said.when(e % 4 == 2, F.concat(lit("oleh PT Maju "), x, lit(" Jaya (Penjual 2)"))).otherwise(F.concat(lit("melalui Biro Administrasi Efek PT Adimitra "), x, lit(" Transferindo Indonesia, kini")))
    return C.role_mentions(events(spark, d).select("e", said.alias("text")), "e", "text")


@query("C09_group_aliases", f"""SELECT e, CASE WHEN e % 4 = 3 THEN 'owner' ELSE 'member' END AS kind, CASE WHEN e % 4 < 2 THEN 'Rimau' ELSE 'Arsari' END AS "group", (['Maju ', 'Maju ', 'Nusantara ', 'Hasyim '])[CAST(e % 4 + 1 AS BIGINT)] || {MARKED} AS name FROM ev""")
def c09(spark, d):
    e, x, lit = F.col("e"), _marked(), F.lit
    said = F.when(e % 4 == 0, F.concat(lit("oleh PT Maju "), x, lit(", disebut bagian Rimau Group"))).when(e % 4 == 1, F.concat(lit("dan Rimau Group melalui PT Maju "), x, lit(", kemarin")))
    said = said.when(e % 4 == 2, F.concat(lit("oleh Nusantara "), x, lit(" (Grup Arsari)"))).otherwise(F.concat(lit("kata grup Arsari milik Hasyim "), x, lit(" sendiri")))
    return C.group_aliases(events(spark, d).select("e", said.alias("text")), "e", "text")


SAID = [("ada rights issue", 1), ("private placement segera", 2), ("tender wajib", 4), ("backdoor", 8), ("penggabungan usaha", 16), ("buy back", 32), ("stock split", 64), ("dividen jumbo", 128), ("kena suspensi", 256), ("delisting", 512), ("kontrak baru", 1024),
    ("crossing besar", 2048), ("pkpu", 4096), ("RUPSLB besok", 8192), ("tender proyek jalan", 0), ("Grup PP dan TO", 4), ("penambahan modal tanpa HMETD", 3)]


@query("C04_topic_bits", f"SELECT e, CAST(({[bits for _, bits in SAID]})[CAST(e % {len(SAID)} + 1 AS BIGINT)] AS BIGINT) AS topics FROM ev")
def c04(spark, d):
    said = F.get(F.array(*(F.lit(text) for text, _ in SAID)), (F.col("e") % len(SAID)).cast("int"))
    return events(spark, d).select("e", topic_bits(said).alias("topics"))


@query("N01_affirmed", "SELECT e, e % 4 IN (1, 3) AS affirmed FROM ev")
def n01(spark, d):
    forms = ["tidak ada rencana rights issue", "tidak ada rencana; namun rights issue jalan", "belum ada. Perseroan tidak berencana buyback atau rights issue", "rights issue disetujui, tidak ada keberatan"]
    return events(spark, d).select("e", T.affirmed(F.get(F.array(*map(F.lit, forms)), (F.col("e") % 4).cast("int")), r"(?i)rights issue").alias("affirmed"))


ENTITIES = """roles AS (SELECT DISTINCT u % 30 AS name, u % 11 AS code, t AS role, day AS date FROM ev),
united AS (SELECT u % 30 AS name, u % 11 AS code, 'holder' AS role, max(day) AS date FROM ev GROUP BY ALL UNION SELECT * FROM roles),
entities AS (SELECT * FROM united QUALIFY row_number() OVER (PARTITION BY name, code ORDER BY date DESC, role) <= 8)"""


def _entities(spark, d):
    e = events(spark, d).select((F.col("u") % 30).alias("name"), (F.col("u") % 11).alias("code"), F.col("day").alias("period"), F.col("t").alias("role"), F.col("day").alias("date"))
    return C.build_entities(e.select("name", "code", "period"), e.select("name", "code", "role", "date"))


@query("C10_build_entities", f", {ENTITIES} SELECT * FROM entities")
def c10(spark, d):
    return _entities(spark, d)


@query("C11_entity_degree", f", {ENTITIES} SELECT name, count(DISTINCT code) AS degree, CASE WHEN count(DISTINCT code) > 5 AND bool_or(role IN ('signup')) THEN 'service' ELSE 'party' END AS kind FROM entities GROUP BY 1")
def c11(spark, d):
    return C.entity_degree(_entities(spark, d), ["signup"])


@plain("C15_official_names", "WITH a AS (SELECT s_nationkey AS code, 'n' || s_suppkey % 5 AS name, 0 AS k FROM supplier UNION ALL SELECT n_nationkey, n_name, 1 FROM nation UNION ALL SELECT c_nationkey, 'n' || c_custkey % 9, 2 FROM customer), f AS (SELECT code, name, min(k) AS k FROM a GROUP BY ALL) SELECT code, string_agg(name, '|' ORDER BY k, name) AS names FROM f GROUP BY 1")
def c15(spark, d):
    side = lambda t, c, name: table(spark, d, t).select(F.col(c).cast("bigint").alias("code"), name.alias("name"))
    n = lambda c, k: F.concat(F.lit("n"), F.col(c) % k)
    named = C.official_names(side("supplier", "s_nationkey", n("s_suppkey", 5)), side("nation", "n_nationkey", F.col("n_name")), side("customer", "c_nationkey", n("c_custkey", 9)))
    return named.select(F.col("code").cast("int").alias("code"), F.array_join("names", "|").alias("names"))


@query("L01_eligible_claims", "SELECT fid FROM ev WHERE (kind <> 'K' OR e % 5 IN (0, 2, 4)) AND NOT (other IN (SELECT code FROM known) AND (e % 5 IN (2, 4) OR (e % 5 = 3 AND e % 2 = 1)))")
def l01(spark, d):
    c = claims(spark, d).withColumn("topics", T.topic_bits("text", ["dividend", "merger", "akuisisi"]))
    return C.eligible_claims(c, known(spark, d)).select("fid")


@query("L06_fallback_verdicts", "SELECT e AS fid, CASE WHEN e % 7 = 1 THEN 'other_topic' WHEN day > DATE '2024-01-20' THEN 'not_checkable' ELSE 'no_basis' END AS verdict FROM ev WHERE e % 3 <> 0")
def l06(spark, d):
    e = events(spark, d).select(F.col("e").alias("fid"), F.col("day").alias("date"))
    return C.fallback_verdicts(e, e.where("fid % 3 = 0"), e.where("fid % 7 = 1"), "2024-01-20").select("fid", "verdict")


@query("E06_rare_claims", """, c AS (SELECT u * 1000 + e % 37 AS entity, t AS handle, e % 2 AS extra, day, e AS fid FROM ev), few AS (SELECT entity FROM c GROUP BY 1 HAVING count(DISTINCT handle) + sum(extra) <= 3 AND count(DISTINCT day) <= 2)
SELECT entity, day, fid, turn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY day DESC, fid) AS INTEGER) AS turn FROM c WHERE entity IN (SELECT entity FROM few)) ORDER BY CASE WHEN turn = 1 THEN 0 ELSE 1 END, day DESC, fid LIMIT 60""")
def e06(spark, d):
    e = events(spark, d).select((F.col("u") * 1000 + F.col("e") % 37).alias("entity"), F.col("t").alias("handle"), (F.col("e") % 2).alias("extra"), "day", F.col("e").alias("fid"))
    return C.rare_claims(e).select("entity", "day", "fid", "turn")


@query("V01_citations", "SELECT e, unnest(list_concat([e % 9, e % 4 + 3, e % 4 + 4, e % 4 + 5], CASE WHEN e % 2 = 0 THEN [7] ELSE [] END)) AS source FROM ev")
def v01(spark, d):
    e = F.col("e")
    said = F.concat(F.lit("as told ["), e % 9, F.lit(", "), e % 4 + 3, F.lit("-"), e % 4 + 5, F.lit("] and"), F.when(e % 2 == 0, " [7]").otherwise(" [x]"))
    return V.citations(events(spark, d).select("e", said.alias("text")), "e", "text").select("e", "source")


@query("V02_invalid_citations", "SELECT DISTINCT u, e % 9 AS source FROM ev WHERE (u, e % 9) NOT IN (SELECT u, e % 5 FROM ev WHERE t = 'view')")
def v02(spark, d):
    e = events(spark, d)
    return V.invalid_citations(e.select("u", (F.col("e") % 9).alias("source")), e.where("t = 'view'").select("u", (F.col("e") % 5).alias("source")).distinct(), "u")


@query("V05_unsupported_counts", "SELECT DISTINCT u, CAST(1000 + e % 9 AS VARCHAR) AS n, 'emiten' AS noun FROM ev WHERE t = 'view' AND (u, e % 9) NOT IN (SELECT u, e % 7 FROM ev WHERE t = 'click')")
def v05(spark, d):
    e = events(spark, d)
    side = lambda t, n: e.where(F.col("t") == t).select("u", F.concat(F.lit("ada "), n, F.lit(" emiten di sini")).alias("text"))
    return V.unsupported_counts(side("view", F.concat(F.lit("1.00"), F.col("e") % 9)), side("click", F.concat(F.lit("100"), F.col("e") % 7)), "u", "text", "emiten|saham")


@plain("V06_wrong_names", "SELECT s_suppkey AS code, 'Lain Sekali Nama' AS name FROM supplier WHERE s_suppkey % 4 = 2")
def v06(spark, d):
    s = table(spark, d, "supplier")
    pick = F.get(F.array(F.lit("Maju Jaya Abadi Sentosa"), F.lit("maju jaya"), F.lit("Lain Sekali Nama"), F.lit("Maju Jaya Abadi Baru")), (F.col("s_suppkey") % 4).cast("int"))
    return V.wrong_names(s.select(F.col("s_suppkey").alias("code"), pick.alias("name")), s.select(F.col("s_suppkey").alias("code"), F.lit("Maju Jaya Abadi Sentosa").alias("official")))


@query("V07_contradictions", "SELECT e, text, 'affiliated' AS flag FROM ev WHERE e % 5 = 0 AND u % 2 = 1 UNION ALL SELECT e, text, 'company' FROM ev WHERE e % 5 = 4 AND u % 3 <> 0")
def v07(spark, d):
    e = events(spark, d)
    flags = e.select("e", (F.col("u") % 2 == 0).alias("affiliated"), (F.col("u") % 3 != 0).alias("company"))
    return V.contradictions(e.select("e", "text"), flags, "e", "text", [("affiliated", "dividend", True), ("company", "akuisisi", False)])


@plain("V08_fix_kind", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'COMPANY' WHEN s_suppkey % 3 = 1 THEN 'INDIVIDUAL' ELSE 'OTHER' END AS kind FROM supplier")
def v08(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 3
    return V.fix_kind(s.select("s_suppkey", F.when(k == 0, F.concat(F.lit("PT "), "s_name")).when(k == 1, "Budi").otherwise("PT X").alias("name"), F.when(k == 2, "OTHER").otherwise("INDIVIDUAL").alias("kind"))).select("s_suppkey", "kind")


@query("V09_number_sources", "SELECT u, source, source % 2 AS kind, CAST(row_number() OVER (PARTITION BY u, source % 2 ORDER BY place, source) AS INTEGER) AS number FROM (SELECT u, e % 13 AS source, min(e) AS place FROM ev GROUP BY ALL)")
def v09(spark, d):
    e = events(spark, d)
    cited = e.select("u", (F.col("e") % 13).alias("source"), F.col("e").alias("place"))
    return V.number_sources(cited, cited.select("source", (F.col("source") % 2).alias("kind")).distinct(), "u")


@query("B05_lead_text", """, l AS (SELECT doc_id, 0 AS k, '# Daily ' || day || chr(10) AS c FROM heads UNION ALL SELECT doc_id, 1, chr(10) FROM heads UNION ALL SELECT doc_id, 2, '""" + PROSE + """' || chr(10) FROM heads UNION ALL SELECT doc_id, 3, chr(10) FROM heads UNION ALL SELECT doc_id, 4, '## ' || code || ' — PT ' || code || ' Tbk' || chr(10) FROM heads UNION ALL SELECT doc_id, 5, chr(10) FROM heads
  UNION ALL SELECT doc_id, 5 + row_number() OVER (PARTITION BY doc_id ORDER BY e), line || chr(10) FROM bullets),
m AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY k) <= 200 AS opens FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM m WHERE NOT opens AND c LIKE '- [R]%')
SELECT doc_id, CAST(k AS INTEGER) AS line, opens, c AS content FROM m WHERE opens UNION ALL SELECT doc_id, CAST(k AS INTEGER), opens, c FROM f WHERE n <= 2""")
def b05(spark, d):
    return B.lead_text(R.lines(daily(spark, d), "doc_id", "text"), "doc_id", r"^- \[R\]", 200, 2)


@query("B07_listing", "SELECT u, day, day || ' · ' || count(*) || ' posts · ' || count(DISTINCT t) || ' accounts · ' || sum(CASE WHEN kind = 'R' THEN 1 ELSE 0 END) || ' findings' AS line FROM ev GROUP BY u, day HAVING (u + day(day)) % 3 <> 0")
def b07(spark, d):
    g = events(spark, d).groupBy("u", "day").agg(F.count("*").alias("posts"), F.countDistinct("t").alias("accounts"), F.sum(F.when(F.col("kind") == "R", 1).otherwise(0)).alias("findings"))
    return B.listing(g, g.where((F.col("u") + F.dayofmonth("day")) % 3 == 0).select("u", "day"), "u")


@query("B08_order_by_source", "SELECT e, CAST(CASE t WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 99 END AS INTEGER) AS place FROM ev")
def b08(spark, d):
    return B.order_by_source(events(spark, d), "t", {"view": 0, "click": 1, "error": 2}, "ts").select("e", "place")


QUERIES, SQL = query.queries | plain.queries, query.sql | plain.sql
