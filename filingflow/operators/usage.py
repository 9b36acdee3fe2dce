"""Usage statistics over questions (id, stamp, user_key, question, normalized, status, terms, mode) and usage (id, stamp, result,
metrics as JSON); stamps are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["input_bytes", "output_tokens", "cost"]


def metric(name: str, col: str = "metrics") -> Column:
    return F.coalesce(F.get_json_object(col, f"$.{name}").try_cast("bigint"), F.lit(0))


def _day(col: str = "stamp") -> Column:
    return F.to_date(F.timestamp_millis(col))


def usage_totals(usage: DataFrame, since: int) -> DataFrame:
    return usage.where(F.col("stamp") >= since).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(metric(m)), F.lit(0)).alias(m) for m in METRICS))


def usage_inputs(questions: DataFrame, since: int) -> DataFrame:
    return questions.where(F.col("stamp") >= since).agg(F.count("*").alias("inputs"), F.countDistinct("user_key").alias("clients"))


def _joined(questions: DataFrame, usage: DataFrame, since: int) -> DataFrame:
    u = usage.select("id", "result", metric("cost").alias("cost"))
    return questions.where(F.col("stamp") >= since).join(u, "id", "left")


def usage_by_mode(questions: DataFrame, usage: DataFrame, since: int) -> DataFrame:
    j = _joined(questions, usage, since)
    return j.groupBy("mode").agg(F.count("*").alias("inputs"), F.count("cost").alias("measured"), F.sum(F.when(F.col("result") == "error", 1).otherwise(0)).alias("errors"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.coalesce(F.max("cost"), F.lit(0)).alias("most"))


def usage_daily_by_mode(questions: DataFrame, usage: DataFrame, since: int) -> DataFrame:
    return _joined(questions, usage, since).groupBy(_day().alias("day"), "mode").agg(F.count("*").alias("inputs"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def usage_page(questions: DataFrame, usage: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of questions, newest first."""
    return _joined(questions, usage, 0).select("id", "stamp", "mode", "status", "cost").orderBy(F.desc("stamp"), F.desc("id")).offset(offset).limit(limit)


def top_questions(questions: DataFrame, usage: DataFrame, k: int = 30) -> DataFrame:
    g = _joined(questions, usage, 0).groupBy("normalized").agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))
    return g.orderBy(F.desc("n"), F.desc("cost"), "normalized").limit(k)


def top_terms(questions: DataFrame, k: int = 30) -> DataFrame:
    terms = questions.select(F.explode(F.from_json("terms", "array<string>")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def expensive_questions(questions: DataFrame, usage: DataFrame, k: int = 30) -> DataFrame:
    g = _joined(questions, usage, 0).where("cost is not null").groupBy("normalized").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))
    return g.orderBy(F.desc("cost"), "normalized").limit(k)


def outcomes(questions: DataFrame) -> DataFrame:
    return questions.groupBy("status").agg(F.count("*").alias("n"))


def usage_daily(questions: DataFrame, usage: DataFrame) -> DataFrame:
    return _joined(questions, usage, 0).groupBy(_day().alias("day")).agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def evidence_view(cached: DataFrame) -> DataFrame:
    """cached (id, rows: JSON array of objects with source and line) as one row an object."""
    return cached.select("id", F.posexplode(F.from_json("rows", "array<struct<source:string,line:bigint>>")).alias("place", "r")).select("id", "place", "r.source", "r.line")


def cohorts(questions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Distinct question ids by the cohort that the ledger (id, cohort) gives them, else 'unknown'."""
    j = questions.select("id").dropDuplicates().join(ledger.dropDuplicates(["id"]), "id", "left")
    return j.groupBy(F.coalesce("cohort", F.lit("unknown")).alias("cohort")).agg(F.count("*").alias("n"))


def diff_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs (id, question, tokens) matched by id, else by question: totals of what both have, percent change, only in one."""
    by_id = a.alias("a").join(b.alias("b"), "id").select(F.col("a.id").alias("a_id"), F.col("id").alias("b_id"))
    rest_a, rest_b = a.join(by_id.select(F.col("a_id").alias("id")), "id", "left_anti"), b.join(by_id.select(F.col("b_id").alias("id")), "id", "left_anti")
    once = lambda df: df.groupBy("question").agg(F.min("id").alias("id"))
    by_text = once(rest_a).alias("x").join(once(rest_b).alias("y"), "question").select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"))
    pairs = by_id.unionByName(by_text)
    full = a.select(F.col("id").alias("a_id"), F.col("tokens").alias("ta")).join(pairs, "a_id", "full").join(b.select(F.col("id").alias("b_id"), F.col("tokens").alias("tb")), "b_id", "full")
    both = F.col("ta").isNotNull() & F.col("tb").isNotNull()
    s = full.agg(F.sum(both.cast("bigint")).alias("matched"), F.sum(F.when(both, F.col("ta"))).alias("tokens_a"), F.sum(F.when(both, F.col("tb"))).alias("tokens_b"), F.sum((F.col("ta").isNotNull() & F.col("tb").isNull()).cast("bigint")).alias("only_a"), F.sum((F.col("ta").isNull() & F.col("tb").isNotNull()).cast("bigint")).alias("only_b"))
    return s.withColumn("change_pct", F.round(100.0 * (F.col("tokens_b") - F.col("tokens_a")) / F.col("tokens_a"), 2))


def run_totals(calls: DataFrame) -> DataFrame:
    """Calls (kind, input_bytes) by kind, and all together under 'all'."""
    r = calls.rollup("kind").agg(F.count("*").alias("calls"), F.sum("input_bytes").alias("input_bytes"), F.grouping("kind").alias("g"))
    return r.select(F.when(F.col("g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "calls", "input_bytes")


def clean_query_log(log: DataFrame, skip_mode: str) -> DataFrame:
    """Questions normalised and merged; of each field the first value that isn't empty, by stamp and id."""
    norm = F.trim(F.regexp_replace(F.lower("question"), r"\s+", " "))
    rows = log.where(F.col("mode") != skip_mode).withColumn("key", norm).where("key != ''")
    first = lambda c: F.min_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.struct("stamp", "id"))).alias(c)
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("stamp").alias("stamp"), first("status"), first("mode"))


def cost_summary(by_mode: DataFrame, cap: int) -> DataFrame:
    """Average cost of an input, and what `cap` inputs at most could cost."""
    return by_mode.select("mode", "inputs", F.round(F.col("cost") / F.col("inputs"), 4).alias("average"), (F.col("most") * cap).alias("ceiling"))
