"""Registered queries on usage (U), with DuckDB SQL. Events stand for questions (mode = type, client = user, terms from props) and
those with a value for measured usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.operators import usage as U
from filingflow.plans.registry import Registry
from filingflow.plans.tables import table

VIEWS = """questions AS (SELECT event_id AS id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS stamp, CAST(user_id AS VARCHAR) AS user_key, event_type || ' ' || props AS question, event_type || ' ' || (user_id % 20) AS normalized,
  CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status, '["k' || json_extract_string(props, '$.k') || '","' || event_type || '"]' AS terms, event_type AS mode FROM events),
usage AS (SELECT event_id AS id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS stamp, CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'ok' END AS result, CAST(floor(value * 100) AS BIGINT) AS cost, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_bytes, user_id AS output_tokens FROM events WHERE event_id % 3 <> 0),
joined AS (SELECT q.*, u.result, u.cost FROM questions q LEFT JOIN usage u ON q.id = u.id)"""
query = Registry(VIEWS)
SINCE = 1705276800000  # 2024-01-15


def questions(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("stamp"), F.col("user_id").cast("string").alias("user_key"), F.concat_ws(" ", "event_type", "props").alias("question"), F.concat_ws(" ", "event_type", F.col("user_id") % 20).alias("normalized"),
        F.when(F.col("event_id") % 17 == 0, "error").otherwise("ok").alias("status"), F.concat(F.lit('["k'), F.get_json_object("props", "$.k"), F.lit('","'), "event_type", F.lit('"]')).alias("terms"), F.col("event_type").alias("mode"),
    )


def usage(spark, d):
    e = table(spark, d, "events").where("event_id % 3 != 0")
    metrics = F.to_json(F.struct(F.floor(F.col("value") * 100).alias("cost"), F.get_json_object("props", "$.k").cast("bigint").alias("input_bytes"), F.col("user_id").alias("output_tokens")))
    return e.select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("stamp"), F.when(F.col("event_id") % 13 == 0, "error").otherwise("ok").alias("result"), metrics.alias("metrics"))


@query("U01_usage_totals", f"SELECT count(*) AS n, CAST(coalesce(sum(input_bytes), 0) AS BIGINT) AS input_bytes, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost FROM usage WHERE stamp >= {SINCE}")
def u01(spark, d):
    return U.usage_totals(usage(spark, d), SINCE)


@query("U02_usage_inputs", f"SELECT count(*) AS inputs, count(DISTINCT user_key) AS clients FROM questions WHERE stamp >= {SINCE}")
def u02(spark, d):
    return U.usage_inputs(questions(spark, d), SINCE)


BY_MODE = f"SELECT mode, count(*) AS inputs, count(cost) AS measured, CAST(sum(CASE WHEN result = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost, coalesce(max(cost), 0) AS most FROM joined WHERE stamp >= {SINCE} GROUP BY 1"


@query("U03_usage_by_mode", BY_MODE)
def u03(spark, d):
    return U.usage_by_mode(questions(spark, d), usage(spark, d), SINCE)


@query("U04_usage_daily_by_mode", f"SELECT CAST(make_timestamp(stamp * 1000) AS DATE) AS day, mode, count(*) AS inputs, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost FROM joined WHERE stamp >= {SINCE} GROUP BY ALL")
def u04(spark, d):
    return U.usage_daily_by_mode(questions(spark, d), usage(spark, d), SINCE)


@query("U05_usage_page", "SELECT id, stamp, mode, status, cost FROM joined ORDER BY stamp DESC, id DESC LIMIT 50 OFFSET 100")
def u05(spark, d):
    return U.usage_page(questions(spark, d), usage(spark, d), 50, 100)


@query("U06_top_questions", "SELECT normalized, count(*) AS n, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost FROM joined GROUP BY 1 ORDER BY n DESC, cost DESC, normalized LIMIT 30")
def u06(spark, d):
    return U.top_questions(questions(spark, d), usage(spark, d))


@query("U07_top_terms", "SELECT term, count(*) AS n FROM (SELECT unnest(from_json(terms, '[\"VARCHAR\"]')) AS term FROM questions) GROUP BY 1 ORDER BY n DESC, term LIMIT 30")
def u07(spark, d):
    return U.top_terms(questions(spark, d))


@query("U08_expensive_questions", "SELECT normalized, CAST(sum(cost) AS BIGINT) AS cost, count(*) AS n FROM joined WHERE cost IS NOT NULL GROUP BY 1 ORDER BY cost DESC, normalized LIMIT 30")
def u08(spark, d):
    return U.expensive_questions(questions(spark, d), usage(spark, d))


@query("U09_outcomes", "SELECT status, count(*) AS n FROM questions GROUP BY 1")
def u09(spark, d):
    return U.outcomes(questions(spark, d))


@query("U10_usage_daily", "SELECT CAST(make_timestamp(stamp * 1000) AS DATE) AS day, count(*) AS n, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost FROM joined GROUP BY 1")
def u10(spark, d):
    return U.usage_daily(questions(spark, d), usage(spark, d))


@query("U11_evidence_view", "SELECT event_id AS id, CAST(i AS INTEGER) AS place, event_type AS source, CAST(json_extract_string(props, '$.k') AS BIGINT) + i AS line FROM events, (VALUES (0), (1)) t(i)")
def u11(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = F.to_json(F.array(F.struct(F.col("event_type").alias("source"), k.alias("line")), F.struct(F.col("event_type").alias("source"), (k + 1).alias("line"))))
    return U.evidence_view(table(spark, d, "events").select(F.col("event_id").alias("id"), rows.alias("rows")))


@query("U12_cohorts", "SELECT coalesce(cohort, 'unknown') AS cohort, count(*) AS n FROM (SELECT DISTINCT id FROM questions) LEFT JOIN (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'real' END AS cohort FROM events WHERE event_id % 4 <> 0) USING (id) GROUP BY 1")
def u12(spark, d):
    ledger = table(spark, d, "events").where("event_id % 4 != 0").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "test").otherwise("real").alias("cohort"))
    return U.cohorts(questions(spark, d), ledger)


RUNS = ", a AS (SELECT id, question, CAST(id % 97 + 10 AS BIGINT) AS tokens FROM questions WHERE id % 5 < 3), b AS (SELECT id, question, CAST(id % 89 + 12 AS BIGINT) AS tokens FROM questions WHERE id % 5 > 1)"


@query("U13_diff_runs", RUNS + """, by_id AS (SELECT id AS a_id, id AS b_id FROM a JOIN b USING (id)), ra AS (SELECT question, min(id) AS a_id FROM a WHERE id NOT IN (SELECT a_id FROM by_id) GROUP BY 1), rb AS (SELECT question, min(id) AS b_id FROM b WHERE id NOT IN (SELECT b_id FROM by_id) GROUP BY 1),
pairs AS (SELECT * FROM by_id UNION ALL SELECT a_id, b_id FROM ra JOIN rb USING (question)), f AS (SELECT a.tokens AS ta, b.tokens AS tb FROM pairs JOIN a ON a.id = a_id JOIN b ON b.id = b_id)
SELECT count(*) AS matched, CAST(sum(ta) AS BIGINT) AS tokens_a, CAST(sum(tb) AS BIGINT) AS tokens_b, (SELECT count(*) FROM a) - count(*) AS only_a, (SELECT count(*) FROM b) - count(*) AS only_b, round(100.0::DOUBLE * (sum(tb) - sum(ta)) / sum(ta), 2) AS change_pct FROM f""")
def u13(spark, d):
    q = questions(spark, d).select("id", "question")
    return U.diff_runs(q.where("id % 5 < 3").withColumn("tokens", F.col("id") % 97 + 10), q.where("id % 5 > 1").withColumn("tokens", F.col("id") % 89 + 12))


@query("U14_run_totals", "SELECT CASE WHEN grouping(mode) = 1 THEN 'all' ELSE mode END AS kind, count(*) AS calls, CAST(sum(input_bytes) AS BIGINT) AS input_bytes FROM questions JOIN usage USING (id) GROUP BY ROLLUP (mode)")
def u14(spark, d):
    calls = questions(spark, d).join(usage(spark, d).select("id", U.metric("input_bytes").alias("input_bytes")), "id").select(F.col("mode").alias("kind"), "input_bytes")
    return U.run_totals(calls)


@query("U15_clean_query_log", "SELECT trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS key, count(*) AS n, min(stamp) AS stamp, arg_min(status, (stamp, id)) AS status, arg_min(mode, (stamp, id)) AS mode FROM questions WHERE mode <> 'error' GROUP BY 1")
def u15(spark, d):
    return U.clean_query_log(questions(spark, d), "error")


@query("U16_cost_summary", f"SELECT mode, inputs, round(CAST(cost AS DOUBLE) / inputs, 4) AS average, most * 3000 AS ceiling FROM ({BY_MODE})")
def u16(spark, d):
    return U.cost_summary(U.usage_by_mode(questions(spark, d), usage(spark, d), SINCE), 3000)


QUERIES, SQL = query.queries, query.sql
