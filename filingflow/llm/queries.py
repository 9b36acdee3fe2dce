"""The registered queries of this subpackage, over whole tables, and DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingflow.llm import collocations, decontamination, jaccard_join, langid, mixing, pii, quality, ranked_search, secret_scan, substring_dedup, token_files, topk, wrapper
from filingflow.llm.common import crc_mod, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 50 = 0"), 5)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_report(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs.where(~held_out).select("doc_id", "text").join(labels, "doc_id"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_passage")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_files.scratch(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.report(spark.read.parquet(path))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_mixing, op3_top_k, op4_language, op5_main_text, op6_jaccard_join, op7_secrets, op8_repeats, op9_personal_data, op10_quality, op11_token_files, op12_ranked_search, op13_collocations, pipeline)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_decontamination": rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
        FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
placed AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT p.r, win.item_id, p.i, p.n FROM placed p JOIN win USING (n, s)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(j) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op3_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 5""",
    "op6_jaccard_join": rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s FROM doc, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS root FROM edge UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT doc.doc_id, coalesce(n.n, 0) AS n_shingles, least(doc.doc_id, coalesce(min(reach.root), doc.doc_id)) AS component_id
FROM doc LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY doc.doc_id, n.n""",
    "op8_repeats": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS s FROM doc, unnest(range(1, len(w) - 48)) AS u(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT doc_id, list(DISTINCT j) AS g FROM later, unnest(range(i, i + 50)) AS u(j) GROUP BY doc_id),
words AS (SELECT doc_id, j, w[j] AS x FROM doc, unnest(range(1, len(w) + 1)) AS u(j)),
out AS (SELECT doc_id, unnest(g) AS j FROM gone),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.j) AS t FROM words LEFT JOIN out ON words.doc_id = out.doc_id AND words.j = out.j WHERE out.j IS NULL GROUP BY words.doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_ranked_search": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM t WHERE len(w) > 0),
tf AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(w) AS x FROM t) GROUP BY r, x),
weight AS (SELECT x, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM s) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY x),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * n_docs) // n_words AS m FROM t, s WHERE len(w) > 0),
qt AS (SELECT q, x, count(*) AS k FROM (SELECT q, unnest(w) AS x FROM q) GROUP BY q, x),
score AS (SELECT q, r, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM qt JOIN weight USING (x) JOIN tf USING (x) JOIN m USING (r) GROUP BY q, r),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS k FROM score JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked JOIN q USING (q) WHERE k <= 20""",
    "op13_collocations": rf"""
WITH piece AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(x, '[^\x20\x09]+') AS w
               FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS x FROM documents WHERE text IS NOT NULL)),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, w[i : i + k - 1] AS ws, count(*) AS a
      FROM piece, unnest(range(1, 4)) AS u(k), unnest(range(1, len(w) - k + 2)) AS v(i) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, ws, CAST(a AS BIGINT) AS a FROM f WHERE k > 1 AND a >= 10),
parts AS (SELECT c.lang, c.phrase, c.ws, c.k AS words, c.a, j, CAST(x.a AS BIGINT) AS l, CAST(y.a AS BIGINT) AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
          FROM cand c, unnest(range(1, c.k)) AS u(j) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1 : c.k], ' ')),
cuts AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(ws[i : i + 1], ' ') AS phrase, max(a) AS longer FROM cand, unnest(range(1, 3)) AS u(i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT c.* FROM cuts c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR c.words = 3 OR 100 * i.longer < 50 * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000""",
}
