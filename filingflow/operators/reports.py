"""Issuer reports of holdings: trust, versions, blocks, sources, roles, filings, and their comparison (K20, K24 to K35, A12 to A14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.operators.relational import first_per, sum_strict

# Bits of roles.
ROLE_BITS = {"block": 1, "controller": 2, "affiliate": 4, "director": 8, "commissioner": 16}


def uncovered_signals(signals: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """signals (key, id, shares, names): those of which the answer has neither the number of shares nor two words of the names."""
    digits = F.regexp_replace(F.coalesce("answer", F.lit("")), r"(?<=\d)[.,](?=\d{3})", "")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"\p{L}{4,}"), F.lit(0)))
    j = signals.join(answers, key, "left").withColumn("digits", digits)
    told = F.coalesce(F.col("digits").contains(F.col("shares").cast("string")), F.lit(False)) | (F.size(F.array_intersect(words("names"), words("answer"))) >= 2)
    return j.where(~told).select(key, "id")


def trust_flags(reports: DataFrame, harmless: list[str]) -> DataFrame:
    """reports (entity, period, validation, issues): comparable if valid or all issues are harmless; conflict if one says so."""
    ok = (F.col("validation") == "ok") | F.forall("issues", lambda i: i.isin(harmless))
    return reports.withColumn("comparable", F.coalesce(ok, F.lit(False))).withColumn("conflict", F.coalesce(F.exists("issues", lambda i: i.startswith("conflict")), F.lit(False)))


def derivable(versions: DataFrame) -> DataFrame:
    """versions (entity, period, name, shares, pct, total): periods in which a name always has the same numbers and there is one total."""
    per_name = versions.groupBy("entity", "period", "name").agg((F.countDistinct(F.struct("shares", "pct")) <= 1).alias("same"), F.min("total").alias("low"), F.max("total").alias("high"))
    return per_name.groupBy("entity", "period").agg((F.bool_and("same") & (F.min("low") == F.max("high"))).alias("derivable"))


def preferred(versions: DataFrame, keys: list[str], valid: str, stamp: str) -> DataFrame:
    """Of the versions of a period a valid one before others, then the latest."""
    return first_per(versions, keys, [F.desc(F.col(valid).cast("int")), F.desc(stamp)])


def blockholders(holders: DataFrame, least: float = 5.0) -> DataFrame:
    """holders (entity, period, party, shares, total, written): shares of holders of at least so much, in percent of the total;
    reconciled if all shares together are the total to within one share."""
    big = F.col("shares") * 100 >= least * F.col("total")
    g = holders.groupBy("entity", "period").agg(sum_strict("shares").alias("all"), F.sum(F.when(big, F.col("shares")).otherwise(0)).alias("block_shares"), F.sum(big.cast("bigint")).alias("holders"), F.max("total").alias("total"))
    return g.select("entity", "period", "holders", "block_shares", F.floor(1000000.0 * F.col("block_shares") / F.col("total")).cast("bigint").alias("block_ppm"), F.coalesce(F.abs(F.col("all") - F.col("total")) <= 1, F.lit(False)).alias("reconciled"))


def written_block(holders: DataFrame) -> DataFrame:
    """From written percents: their sum over blocks; rejected if one is more than a point off what the implied total (upper median of
    shares per percent) gives."""
    implied = F.when(F.col("pct") > 0, F.col("shares") / F.col("pct") * 100)
    total = holders.groupBy("entity", "period").agg(F.array_sort(F.collect_list(implied)).alias("xs")).select("entity", "period", F.get("xs", F.floor(F.size("xs") / 2).cast("int")).alias("implied"))
    j = holders.join(total, ["entity", "period"])
    off = F.abs(F.col("pct") - F.col("shares") / F.col("implied") * 100) > 1
    return j.groupBy("entity", "period").agg(F.round(F.sum(F.when(F.col("pct") >= 5, F.col("pct")).otherwise(0.0)), 4).alias("written"), F.coalesce(F.bool_or(off), F.lit(False)).alias("rejected"))


def coalesce_sources(report: DataFrame, snapshot: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """The value of the report, else of the snapshot, else the written one, with the source's letter."""
    j = report.select(*keys, F.col("value").alias("r")).join(snapshot.select(*keys, F.col("value").alias("k")), keys, "full").join(written.select(*keys, F.col("value").alias("p")), keys, "full")
    source = F.when(F.col("r").isNotNull(), "R").when(F.col("k").isNotNull(), "K").when(F.col("p").isNotNull(), "P")
    return j.select(*keys, F.coalesce("r", "k", "p").alias("value"), source.alias("source"))


def report_metrics(versions: DataFrame) -> DataFrame:
    """versions (entity, period, metric, value, chosen): the chosen version's value and those of others that differ."""
    g = versions.groupBy("entity", "period", "metric").agg(F.max(F.when(F.col("chosen"), F.col("value"))).alias("value"), F.array_sort(F.collect_set("value")).alias("all"))
    return g.withColumn("others", F.array_except("all", F.array("value"))).drop("all")


def report_rows(holders: DataFrame, aggregates: str = r"(?i)^(afiliasi|masyarakat|publik|lainnya|subtotal|jumlah)\b") -> DataFrame:
    """holders (entity, period, name, shares, roles): roles as bits, whether the name stands for several, and twice; largest first."""
    bits = F.aggregate(F.transform(F.array_distinct("roles"), lambda r: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_BITS.items() for x in kv]), r), F.lit(0))), F.lit(0), lambda a, b: a + b)
    n = F.count("*").over(Window.partitionBy("entity", "period", "name"))
    return holders.select("entity", "period", "name", "shares", bits.alias("role_bits"), F.col("name").rlike(aggregates).alias("aggregate"), (n > 1).alias("twice")).orderBy("entity", "period", F.desc("shares"), "name")


def owner_types(first: DataFrame, second: DataFrame) -> DataFrame:
    """(domicile, type, shares) of two periods side by side, with totals of each domicile and of all (nulls in the rolled-up columns)."""
    j = first.select("domicile", "type", F.col("shares").alias("a")).join(second.select("domicile", "type", F.col("shares").alias("b")), ["domicile", "type"], "full")
    return j.rollup("domicile", "type").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.grouping_id().alias("level"))


def filings(rows: DataFrame, audit: DataFrame, start: str, end: str) -> DataFrame:
    """rows (url, date, party, shares, text) in (start, end] with their audit notes; a note on percent counts only if the text has the
    number of shares."""
    digits = F.regexp_replace("text", r"(?<=\d)[.,](?=\d{3})", "")
    inside = rows.where((F.col("date") > F.lit(start).cast("date")) & (F.col("date") <= F.lit(end).cast("date"))).withColumn("found", digits.contains(F.col("shares").cast("string")))
    notes = inside.select("url", "date", "found").distinct().join(audit, ["url", "date"]).where((F.col("kind") != "percent") | F.col("found")).groupBy("url", "date").agg(F.array_sort(F.collect_set("note")).alias("notes"))
    return inside.join(notes, ["url", "date"], "left").drop("found")


def filing_cards(rows: DataFrame) -> DataFrame:
    """rows (id, date, before, after, tx: array of (shares, price, date)): value, days from the last transaction to the report, change."""
    value = F.aggregate("tx", F.lit(0.0), lambda a, t: a + t["shares"] * t["price"])
    return rows.select("id", value.alias("value"), F.datediff("date", F.array_max(F.transform("tx", lambda t: t["date"]))).alias("days"), (F.col("after") - F.col("before")).alias("change"))


def in_range(rows: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Whether each row lies in (start, end]."""
    return rows.withColumn("inside", F.coalesce((F.col(date) > F.lit(start).cast("date")) & (F.col(date) <= F.lit(end).cast("date")), F.lit(False)))


def compare_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, role, shares) of two reports: matched by name and role, else by a name that either side has once; what stays is only in one."""
    x, y = (df.select("name", "role", "shares") for df in (a, b))
    exact = x.select("name", "role", F.col("shares").alias("shares_a")).join(y.select("name", "role", F.col("shares").alias("shares_b")), ["name", "role"]).withColumn("how", F.lit("role"))
    rest_a, rest_b = x.join(exact, ["name", "role"], "left_anti"), y.join(exact, ["name", "role"], "left_anti")
    single = lambda df, s: df.groupBy("name").agg(F.count("*").alias("n"), F.max("role").alias(f"role_{s}"), F.max("shares").alias(f"shares_{s}")).where("n = 1").drop("n")
    by_name = single(rest_a, "a").join(single(rest_b, "b"), "name").select("name", F.col("role_b").alias("role"), "shares_a", "shares_b", F.lit("name").alias("how"))
    only = lambda df, s, o: df.join(by_name.select("name"), "name", "left_anti").select("name", "role", F.col("shares").alias(f"shares_{s}"), F.lit(None).cast("bigint").alias(f"shares_{o}"), F.lit(f"only_{s}").alias("how"))
    return exact.unionByName(by_name).unionByName(only(rest_a, "a", "b")).unionByName(only(rest_b, "b", "a"))


# Words of a name that spellings of one holder may differ in.
SPELLING_NOISE = ["PT", "TBK", "PERSERO", "LTD", "LIMITED", "PTE", "INC", "CO", "CORP", "DRS", "DRA", "IR", "DR", "SE", "SH"]


def match_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, shares) of holders left over in two lists: pairs that are one holder in two spellings, if each fits the other alone. A pair
    fits by equal words in any order, or by equal shares and a word in common, one of which may be the beginning of the other where both
    have four signs at least. Without shares above 0 they fit by words only."""
    words = lambda c: F.filter(F.split(F.upper(F.col(c)), "[^A-Z0-9]+"), lambda w: (w != "") & ~w.isin(SPELLING_NOISE))
    side = lambda df, s: df.select(F.col("name").alias(f"name_{s}"), "shares", F.array_sort(words("name")).alias(f"words_{s}"), F.array_join(F.array_sort(words("name")), " ").alias("key"))
    x, y = side(a, "a"), side(b, "b")
    meets = lambda t, u: (t == u) | ((F.length(t) >= 4) & (F.length(u) >= 4) & (t.startswith(u) | u.startswith(t)))
    by_words = x.drop("shares").join(y.drop("shares"), "key").select("name_a", "name_b")
    by_shares = x.drop("key").join(y.drop("key"), "shares").where("shares > 0").where(F.exists("words_a", lambda t: F.exists("words_b", lambda u: meets(t, u)))).select("name_a", "name_b")
    pairs = by_words.union(by_shares).distinct()
    once = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(c)
    return pairs.join(once("name_a"), "name_a", "left_semi").join(once("name_b"), "name_b", "left_semi").select("name_a", "name_b")
