"""Checks and incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.operators.relational import explode_days, first_per


def eligible_days(days: DataFrame, holds: DataFrame, published: DataFrame, since: str, provisional: bool = False) -> DataFrame:
    """days (day, state, ok): final days (perhaps provisional ones) that are ok, not held, known once, and not before `since` unless
    published already."""
    once = days.groupBy("day").agg(F.count("*").alias("n")).where("n = 1").select("day")
    states = ["final", "provisional"] if provisional else ["final"]
    new = days.where(F.col("ok") & F.col("state").isin(states)).join(holds.select("day"), "day", "left_anti").join(once, "day", "left_semi")
    known = new.join(published.select("day", F.lit(True).alias("known")).distinct(), "day", "left")
    return known.where((F.col("day") >= F.lit(since).cast("date")) | F.col("known")).select("day", "state")


def merge_holds(old: DataFrame, withheld: DataFrame) -> DataFrame:
    """(day, level) old and new: what stays, is added, released, or lowered to the new level."""
    j = old.select("day", F.col("level").alias("was")).join(withheld.select("day", F.col("level").alias("now")), "day", "full")
    action = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "release").when(F.col("now") < F.col("was"), "lower").otherwise("keep")
    return j.select("day", "was", "now", action.alias("action"))


def withdrawn(files: DataFrame, days: DataFrame) -> DataFrame:
    """Files (doc_id, start, end) that cover a withheld day."""
    return explode_days(files, "start", "end").join(days.select("day"), "day", "left_semi").select("doc_id").distinct()


def assert_not_shrinking(eligible: DataFrame, held: DataFrame, aged: DataFrame, published: DataFrame) -> int:
    """Refuses a load that would publish fewer days than are published; gives the number of days."""
    kept = eligible.select("day").union(held.select("day")).union(aged.select("day")).distinct().count()
    before = published.select("day").distinct().count()
    if kept < before:
        raise ValueError(f"{kept} days would replace {before}")
    return kept


def changed_rows(new: DataFrame, state: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """Rows that the state doesn't have with the same fingerprint."""
    j = new.join(state.select(key, F.col(fingerprint).alias("_known")), key, "left")
    return j.where(~F.col("_known").eqNullSafe(F.col(fingerprint))).drop("_known")


def complete_weeks(days: DataFrame) -> DataFrame:
    """Mondays of the weeks whose seven days are all there."""
    return days.select("day").distinct().groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(F.count("*").alias("n")).where("n = 7").select("week")


def filter_days(index: DataFrame, drop: DataFrame) -> DataFrame:
    """Index rows (key, day, ...) without the dropped days, days numbered anew; keys without days go by themselves."""
    kept = index.join(drop.select("day"), "day", "left_anti")
    numbers = kept.select("day").distinct()
    before = numbers.alias("a").join(numbers.select(F.col("day").alias("other")), F.col("other") < F.col("a.day"), "left").groupBy("day").agg(F.count("other").alias("day_idx"))
    return kept.join(F.broadcast(before), "day")


def check_refs(rows: DataFrame, days: DataFrame, key: str) -> DataFrame:
    """Rows whose day is not published exactly once."""
    once = days.groupBy("day").agg(F.count("*").alias("n"))
    return rows.join(once, "day", "left").where(F.coalesce("n", F.lit(0)) != 1).select(key, "day", F.coalesce("n", F.lit(0)).alias("published"))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the names of the rules that they break; a rule that gives null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    marked = df.withColumn("broken", F.array_join(broken, ","))
    return marked.where("broken = ''").drop("broken"), marked.where("broken != ''")


def check_files(files: DataFrame, expected: DataFrame, quarantine: str) -> DataFrame:
    """Files (name, cat, body, sha): what is wrong with each: category or hash unlike the expected (name, cat, sha), empty, or a
    quarantined id in it."""
    j = files.join(expected.select("name", F.col("cat").alias("x_cat"), F.col("sha").alias("x_sha")), "name", "left")
    wrong = F.array_compact(F.array(F.when(F.col("x_cat").isNull(), F.lit("name")), F.when(F.col("x_cat") != F.col("cat"), F.lit("category")), F.when(F.col("x_sha") != F.sha2("body", 256), F.lit("hash")), F.when(F.length(F.trim("body")) == 0, F.lit("empty")), F.when(F.col("body").rlike(quarantine), F.lit("quarantine"))))
    return j.select("name", F.array_join(wrong, ",").alias("issues"))


def latest_state(log: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    return first_per(log, [key], [F.desc(stamp), F.desc(tie)])


def reconcile(expected: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Expected against produced rows: missing, extra or several."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("expected"))
    p = produced.groupBy(*keys).agg(F.count("*").alias("produced"))
    j = e.join(p, keys, "full").fillna(0, ["expected", "produced"])
    issue = F.when(F.col("produced") == 0, "missing").when(F.col("expected") == 0, "extra").when(F.col("produced") > F.col("expected"), "several")
    return j.withColumn("issue", issue).where("issue is not null")


def check_windows(df: DataFrame) -> DataFrame:
    """Windows (name, start, end as texts): times that are none or in the wrong order, and names that stand twice."""
    a, b = F.try_to_timestamp("start", F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp("end", F.lit("yyyy-MM-dd HH:mm"))
    n = F.count("*").over(Window.partitionBy("name"))
    wrong = F.array_compact(F.array(F.when(a.isNull() | b.isNull(), F.lit("time")), F.when(a >= b, F.lit("order")), F.when(n > 1, F.lit("twice"))))
    return df.select("name", "start", "end", F.array_join(wrong, ",").alias("issues"))
