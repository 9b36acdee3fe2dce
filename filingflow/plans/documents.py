"""Registered queries on texts: T, R, X, N, C, L, E, V and B, with DuckDB SQL where SQL can say it on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.functions import text as T
from filingflow.functions.names import is_company
from filingflow.operators import audit as V
from filingflow.operators import budget as B
from filingflow.operators import claims as C
from filingflow.operators import records as R
from filingflow.operators import search as X
from filingflow.plans.registry import Registry
from filingflow.plans.tables import table
from filingflow.sources import files as S

query = Registry()


def docs(spark, d):
    return table(spark, d, "documents")


@query("T01_html_to_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<template\b.*?</template>|<svg\b.*?</svg>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def t01(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text("html").alias("text"))


@query("T03_html_info", r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1\b[^>]*>(.*?)</h1>', 1, 'is'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '<title\b[^>]*>(.*?)</title>', 1, 'is'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '')) AS title FROM pages""")
def t03(spark, d):
    return R.html_info(table(spark, d, "pages"), "page_id", "html").select("page_id", "title")


@query("T04_codes", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{4}')))), ',') AS codes FROM documents")
def t04(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(F.array_sort(T.codes("text")), ",").alias("codes"))


@query("T05_text_stats", r"SELECT doc_id, CAST(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS signs, CAST(strlen(text) AS INTEGER) AS bytes, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS lines FROM documents")
def t05(spark, d):
    return R.text_stats(docs(spark, d), "doc_id", "text")


@query("T06_text_kit", r"""SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(substr(text, 1, 79), ' ') || '…' END AS clip FROM documents""")
def t06(spark, d):
    return docs(spark, d).select("doc_id", T.norm_text("text").alias("norm"), T.slug("text").alias("slug"), T.clip("text", 80).alias("clip"))


@query("T09_redact", r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?i)\b(passcode|kode akses|pin)(\s*[:=]\s*)\S+', '\1\2[code]', 'g'), '(?i)([?&]pwd=)[^&\s]+', '\1[code]', 'g') AS text FROM conversations""")
def t09(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.masked("text").alias("text"))


@query("T10_quarantine_hits", "SELECT DISTINCT doc_id, id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,20}')) AS id FROM documents) WHERE id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)")
def t10(spark, d):
    ids = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"))
    found = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{1,20}"), F.lit(0))).alias("id"))
    return found.join(ids, "id", "left_semi").select("doc_id", "id").distinct()


@query("S14_split_bytes")
def s14(spark, d):
    return S.split_bytes(docs(spark, d), "doc_id", "text", 1000)


POSTINGS = r"postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) WHERE NOT regexp_full_match(term, '[0-9]{7,}') GROUP BY ALL)"


@query("X01_build_postings", f"WITH {POSTINGS} SELECT term, doc_id, tf FROM postings")
def x01(spark, d):
    return X.build_postings(docs(spark, d), "doc_id", "text")


@query("X02_search", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])(apache license|the theredthe|de la)($|[^\p{L}\p{N}])')")
def x02(spark, d):
    p, terms = docs(spark, d), ["apache license", "the theredthe", "de la"]
    return X.search(p, X.build_postings(p, "doc_id", "text", X.words_of(terms)), "doc_id", "text", terms).select("doc_id")


@query("X03_count_hits", "SELECT doc_id, CAST(least((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4, 999) AS INTEGER) AS hits FROM documents WHERE contains(lower(text), 'tion')")
def x03(spark, d):
    return X.count_hits(docs(spark, d), "doc_id", "text", "tion")


@query("X04_select_records")
def x04(spark, d):
    return X.select_records(R.partition_records(docs(spark, d), "doc_id", "text"), "doc_id", r"(?i)\blicensed?\b").select("doc_id", "ordinal", "why")


@query("X09_nearest_terms")
def x09(spark, d):
    terms = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{6,}"), F.lit(0))).alias("term")).distinct()
    return X.nearest_terms(terms, X.vocabulary(docs(spark, d), "text"))


@query("X10_longest_known_phrase")
def x10(spark, d):
    phrases = table(spark, d, "benchmark").select(F.explode(F.transform(F.split("text", r"[.,\n]+"), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))).alias("phrase")).where("phrase != ''")
    return X.longest_known_phrase(docs(spark, d), "doc_id", "text", phrases, 5)


@query("X12_infer_handles", r"SELECT handle, CAST(sum(CASE WHEN t LIKE '@%' THEN 1 ELSE 0 END) AS BIGINT) AS marked, count(*) AS n FROM (SELECT t, regexp_replace(t, '^@', '') AS handle FROM (SELECT unnest(regexp_extract_all(lower(text), '@?[a-z0-9_]{3,}')) AS t FROM documents)) GROUP BY 1 HAVING sum(CASE WHEN t LIKE '@%' THEN 1 ELSE 0 END) > 0 AND 2 * sum(CASE WHEN t LIKE '@%' THEN 1 ELSE 0 END) >= count(*)")
def x12(spark, d):
    return X.infer_handles(docs(spark, d), "text")


@query("X14_top_passages")
def x14(spark, d):
    return X.top_passages(R.partition_records(docs(spark, d), "doc_id", "text"), "doc_id", ["licensed", "apache", "rights", "reserved"])


@query("X17_rare_terms", rf"WITH {POSTINGS}, w AS (SELECT DISTINCT item_id, lower(unnest(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: regexp_matches(x, '^\p{{Lu}}')))) AS term FROM benchmark), n AS (SELECT term, count(*) AS docs FROM postings GROUP BY 1) SELECT item_id, term, docs FROM w JOIN n USING (term) WHERE docs <= 10")
def x17(spark, d):
    return X.rare_terms(table(spark, d, "benchmark"), "item_id", "text", X.build_postings(docs(spark, d), "doc_id", "text"))


@query("X18_negated_only", "SELECT user_id * 100 + day(ts) AS doc_id, count(*) AS hits FROM events WHERE event_type <> 'view' GROUP BY 1 HAVING bool_and(event_id % 3 = 0)")
def x18(spark, d):
    """Records of a user's day: some name a rights issue, others deny it, others speak of something else."""
    denied = F.when(F.col("event_type") == "view", "laporan biasa").when(F.col("event_id") % 3 == 0, "tidak ada rencana rights issue").otherwise("ada rights issue; tidak ada keberatan")
    records = table(spark, d, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("doc_id"), denied.alias("content"))
    return X.negated_only(records, "doc_id", r"(?i)rights issue")


@query("C03_fold_duplicates", "SELECT text, min(doc_id) AS doc_id, count(*) - 1 AS n_dups FROM documents GROUP BY 1")
def c03(spark, d):
    from filingflow.operators.relational import fold_duplicates

    return fold_duplicates(docs(spark, d).select("doc_id", "text"), ["text"], [F.asc("doc_id")], "doc_id").select("text", "doc_id", F.size("dups").cast("bigint").alias("n_dups"))


TOPIC_PATTERNS = ["(?i)license", "(?i)password|token", "(?i)@[a-z0-9]", "(?i)\\|", "(?i)!!", "(?i)stupid|worthless|pathetic"]


@query("C12_spelling_variants", r"""WITH t AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{L}{5,}'))) AS token FROM benchmark), v AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{L}{5,}'))) AS word FROM conversations)
SELECT token, word FROM t JOIN v ON token[1] = word[1] AND token <> word AND abs(length(token) - length(word)) <= 1 WHERE (length(token) = length(word) AND len(list_filter(range(1, length(token) + 1), lambda i: token[i] <> word[i])) = 1)
  OR (length(token) <> length(word) AND len(list_filter(range(1, greatest(length(token), length(word)) + 1), lambda i: CASE WHEN length(token) > length(word) THEN token[1:i-1] || token[i+1:] = word ELSE word[1:i-1] || word[i+1:] = token END)) > 0)""")
def c12(spark, d):
    words = lambda t: F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\p{L}{5,}\b"), F.lit(0)))
    return C.spelling_variants(table(spark, d, "benchmark").select(words("t").alias("token")), table(spark, d, "conversations").select(words("t").alias("word")))


@query("C13_name_like", r"""WITH t AS (SELECT unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{L}{2,}'))) AS t FROM documents), g AS (SELECT lower(t) AS token, sum(CASE WHEN regexp_matches(t, '^\p{Lu}') THEN 1 ELSE 0 END) AS capital, sum(CASE WHEN regexp_matches(t, '^\p{Lu}') THEN 0 ELSE 1 END) AS lower FROM t GROUP BY 1)
SELECT token, CAST(capital AS BIGINT) AS capital, CAST(lower AS BIGINT) AS lower FROM g WHERE capital >= 2 AND capital >= lower""")
def c13(spark, d):
    return C.name_like(docs(spark, d), "text")


@query("C14_is_company", "SELECT c_custkey, c_custkey % 3 <> 2 AS company FROM customer")
def c14(spark, d):
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.concat(F.lit("PT "), "c_name")).when(k == 1, "Maju Jaya Abadi Sentosa").otherwise("Budi Santoso")
    return table(spark, d, "customer").select("c_custkey", is_company(name).alias("company"))


@query("L05_trend", "WITH m AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY day DESC) AS k FROM m), g AS (SELECT user_id, event_type, arg_min(n, day) AS \"from\", arg_max(n, day) AS \"to\", max(day) AS observed FROM r WHERE k <= 3 GROUP BY ALL) SELECT *, CASE WHEN \"to\" > \"from\" THEN 'up' WHEN \"to\" < \"from\" THEN 'down' ELSE 'flat' END AS direction FROM g")
def l05(spark, d):
    m = table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return C.trend(m, ["user_id", "event_type"], "day", "n")


@query("L07_best_verdict", "SELECT user_id AS fid, arg_min(v, r) AS verdict, count(*) AS checks FROM (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'supported' WHEN 'error' THEN 'contradicted' ELSE 'no_basis' END AS v, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 5 END AS r FROM events) GROUP BY 1")
def l07(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("fid"), F.when(F.col("event_type") == "purchase", "supported").when(F.col("event_type") == "error", "contradicted").otherwise("no_basis").alias("verdict"))
    return C.best_verdict(e)


@query("E01_mentions_topk", "WITH m AS (SELECT s_nationkey AS code, l_suppkey AS filer, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS ref, CASE WHEN l_returnflag = 'R' THEN 'transaksi_saham' ELSE 'lain' END AS relation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY code, filer, relation ORDER BY date DESC, ref) = 1) SELECT code, filer, date, ref, relation FROM u QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE WHEN relation = 'transaksi_saham' THEN 1 ELSE 0 END DESC, date DESC, ref) <= 8")
def e01(spark, d):
    relation = F.when(F.col("l_returnflag") == "R", "transaksi_saham").otherwise("lain")
    m = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("code"), F.col("l_suppkey").alias("filer"), F.to_date("l_shipdate").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), relation.alias("relation"), relation.alias("snippet"))
    return C.mentions_topk(m).select("code", "filer", "date", "ref", "relation")


@query("E02_relation_pairs", "WITH r AS (SELECT DISTINCT l_suppkey AS party, p_brand AS entity, CASE WHEN l_suppkey % 7 = 0 THEN 'service' ELSE 'role' || (p_size % 2) END AS role FROM lineitem JOIN part ON l_partkey = p_partkey), j AS (SELECT x.entity AS a, y.entity AS b, party, max(CASE WHEN x.role = 'service' OR y.role = 'service' THEN 0 WHEN x.role = y.role THEN 2 ELSE 1 END)::INTEGER AS tier FROM r x JOIN r y USING (party) WHERE x.entity < y.entity GROUP BY ALL) SELECT a, b, party, tier FROM j QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY tier DESC, party) <= 14")
def e02(spark, d):
    r = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    roles = r.select(F.col("l_suppkey").alias("party"), F.col("p_brand").alias("entity"), F.when(F.col("l_suppkey") % 7 == 0, "service").otherwise(F.concat(F.lit("role"), F.col("p_size") % 2)).alias("role")).distinct()
    return C.relation_pairs(roles)


@query("E04_cascade_search", "WITH p AS (SELECT doc_id, CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'tion') AND (contains(lower(text), 'apache') OR contains(lower(text), 'rights')) THEN 1 WHEN contains(lower(text), 'the') AND contains(lower(text), 'tion') THEN 2 WHEN contains(lower(text), 'the') OR contains(lower(text), 'tion') THEN 3 END AS level FROM documents) SELECT doc_id, level FROM p WHERE level = (SELECT min(level) FROM p)")
def e04(spark, d):
    return C.cascade_search(docs(spark, d), "doc_id", "text", ["the", "tion"], ["apache", "rights"])


@query("E07_handle_profile", "SELECT user_id AS handle, count(*) AS posts, count(DISTINCT event_id) AS findings, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT user_id % 7) AS entities, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT event_type AS x FROM events i WHERE i.user_id = o.user_id)) AS kinds, " + ", ".join(f"CAST(sum((event_id >> {i}) & 1) AS BIGINT) AS topic_{i}" for i in range(4)) + " FROM events o GROUP BY 1")
def e07(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("handle"), F.col("event_type").alias("kind"), F.col("event_id").alias("topics"), F.to_date("ts").alias("day"), F.col("event_id").alias("fid"), (F.col("user_id") % 7).alias("entity"))
    return C.handle_profile(e)


@query("E09_daily_rollup", "SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(event_id % 10) AS BIGINT) AS posts, count(*) AS rows, CAST(grouping(event_type, CAST(ts AS DATE)) AS BIGINT) AS level FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))")
def e09(spark, d):
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), (F.col("event_id") % 10).alias("posts"))
    return C.daily_rollup(e, ["event_type", "day"], ["posts"])


def _answers(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "text")


SAID = """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(o_orderkey % 500 + 2000 AS VARCHAR) AS n FROM orders)"""


def _said(spark, d):
    """Answers with numbers in several spellings, and what their sources say."""
    k, n = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 500 + 2000).cast("int")
    answer = F.when(k == 0, "total 1.250 saham").when(k == 1, F.concat(F.lit("total "), n)).when(k == 2, "sekitar 98 saja").when(k == 3, "nilai 5,5 juta").when(k == 4, "nilai 7,25 miliar").otherwise("tanpa angka")
    source = F.when(k == 0, "1250 lembar").when(k == 1, F.concat(n + 5, F.lit(" lembar"))).when(k == 2, "100 lembar").when(k == 3, "5500000").when(k == 4, "7000000000").otherwise("12")
    o = table(spark, d, "orders")
    return V.extract_numbers(o.select("o_orderkey", answer.alias("text")), "o_orderkey", "text"), V.extract_numbers(o.select("o_orderkey", source.alias("text")), "o_orderkey", "text")


@query("V03_extract_numbers", f"""{SAID}, r AS (SELECT o_orderkey, unnest(CASE k WHEN 0 THEN [{{'w': '1.250', 'v': 1250.0, 'u': 1.0, 'a': false}}, {{'w': '1.250', 'v': 1.25, 'u': 0.001, 'a': false}}] WHEN 1 THEN [{{'w': n, 'v': CAST(n AS DOUBLE), 'u': 1.0, 'a': false}}] WHEN 2 THEN [{{'w': '98', 'v': 98.0, 'u': 1.0, 'a': true}}]
  WHEN 3 THEN [{{'w': '5,5', 'v': 55000000.0, 'u': 1000000.0, 'a': false}}, {{'w': '5,5', 'v': 5500000.0, 'u': 100000.0, 'a': false}}] WHEN 4 THEN [{{'w': '7,25', 'v': 725000000000.0, 'u': 1000000000.0, 'a': false}}, {{'w': '7,25', 'v': 7250000000.0, 'u': 10000000.0, 'a': false}}] ELSE [] END) AS x FROM o)
SELECT o_orderkey, CAST(0 AS INTEGER) AS place, x.w AS written, CAST(x.v AS DOUBLE) AS value, CAST(x.u AS DOUBLE) AS unit, x.a AS approximate FROM r""")
def v03(spark, d):
    return _said(spark, d)[0].select("o_orderkey", "place", "written", F.round("value", 6).alias("value"), F.round("unit", 6).alias("unit"), "approximate")


@query("V04_unsupported_numbers", f"{SAID} SELECT o_orderkey, CASE k WHEN 1 THEN n ELSE '7,25' END AS written FROM o WHERE k IN (1, 4)")
def v04(spark, d):
    return V.unsupported_numbers(*_said(spark, d), "o_orderkey").select("o_orderkey", "written").distinct()


@query("E08_uncovered_claims", r"""WITH u AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '\p{L}{4,}')) AS own FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(coalesce(string_agg(text, ' '), '')), '\p{L}{4,}')) AS said FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id, turn FROM u LEFT JOIN a USING (conv_id) WHERE len(own) > 0 AND len(list_intersect(own, coalesce(said, []))) < 0.6 * len(own)""")
def e08(spark, d):
    c = table(spark, d, "conversations")
    answers = c.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.collect_list("text"), " ").alias("answer"))
    return C.uncovered(c.where("role = 'user'").select("conv_id", "turn", "text"), "text", answers, "conv_id", "answer").select("conv_id", "turn")


@query("B01_prefix_budget", "SELECT doc_id, source, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, source, sum(n_chars) OVER w AS used, row_number() OVER w AS k FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)) WHERE used <= 20000 OR k = 1")
def b01(spark, d):
    return B.prefix_budget(docs(spark, d).select("doc_id", "source", "n_chars"), "source", [F.desc("doc_id")], "n_chars", 20000).select("doc_id", "source", "used")


@query("B02_greedy_budget", """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, turn, size, n, size <= 600 AS ok, CASE WHEN size <= 600 THEN 600 - size ELSE 600 END AS rest FROM t WHERE n = 1 UNION ALL SELECT t.conv_id, t.turn, t.size, t.n, t.size <= rest, CASE WHEN t.size <= rest THEN rest - t.size ELSE rest END FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
SELECT conv_id, turn, CAST(size AS INTEGER) AS size FROM r WHERE ok""")
def b02(spark, d):
    return B.greedy_budget(table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size")), "conv_id", ["turn"], "size", 600)


@query("B03_round_robin_budget", """WITH RECURSIVE e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_id % 50 + 1 AS size, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS turn FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn, day DESC) AS n FROM e),
r AS (SELECT user_id, n, event_id, day, size, size <= 500 AS ok, CASE WHEN size <= 500 THEN 500 - size ELSE 500 END AS rest, CASE WHEN size <= 500 THEN [] ELSE [day] END AS ended FROM t WHERE n = 1
  UNION ALL SELECT t.user_id, t.n, t.event_id, t.day, t.size, t.size <= rest AND NOT list_contains(ended, t.day), CASE WHEN t.size <= rest AND NOT list_contains(ended, t.day) THEN rest - t.size ELSE rest END, CASE WHEN t.size <= rest OR list_contains(ended, t.day) THEN ended ELSE list_append(ended, t.day) END FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
SELECT user_id, day, event_id, size FROM r WHERE ok""")
def b03(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", (F.col("event_id") % 50 + 1).alias("size"))
    return B.round_robin_budget(e, "user_id", "day", ["event_id"], "size", 500)


@query("B06_pack_batches", """WITH RECURSIVE t AS (SELECT user_id, event_id, event_id % 50 + 1 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, size, n, 0 AS batch, size AS used FROM t WHERE n = 1 UNION ALL SELECT t.user_id, t.event_id, t.size, t.n, CASE WHEN used > 0 AND used + t.size > 120 THEN batch + 1 ELSE batch END, CASE WHEN used > 0 AND used + t.size > 120 THEN t.size ELSE used + t.size END FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
SELECT user_id, event_id, size, CAST(batch AS BIGINT) AS batch FROM r""")
def b06(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 50 + 1).alias("size"))
    return B.pack_batches(e, "user_id", ["event_id"], "size", 120)


QUERIES, SQL = query.queries, query.sql
