"""Checks of forum claims against disclosures, mentions and holdings: a cascade of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions.names import party_key
from filingflow.operators import rules

#: Verdicts from the strongest to the weakest, and how many a claim has at most.
SUPPORTED, CONTRADICTED, RECORDED, OTHER, NOT_CHECKABLE, NO_BASIS = "supported", "contradicted", "recorded", "other_topic", "not_checkable", "no_basis"
MOST = 4
TOPICS = [name for name, _ in rules.TOPIC_PATTERNS]
BIT = {name: 1 << k for k, name in enumerate(TOPICS)}


def mask(topics: list[str]) -> int:
    return sum(BIT[t] for t in topics)


def topic_bits(text: Column) -> Column:
    """Bit k is set where topic k's pattern stands in a text; null has none."""
    out = F.lit(0).cast("bigint")
    for name, pattern in rules.TOPIC_PATTERNS:
        out = out + F.when(text.rlike(pattern), F.lit(BIT[name])).otherwise(F.lit(0))
    return out.cast("bigint")


def _near(claims: DataFrame, other: DataFrame, days: int, date: str) -> DataFrame:
    """claims joined with rows of their code within so many days, as an equi-join on bins as wide as the window."""
    bin_of = lambda c: F.floor(F.unix_date(F.col(c)) / F.lit(days))
    a = claims.withColumn("_bin", bin_of("date"))
    b = other.withColumn("_bin", F.explode(F.array(*(bin_of(date) + k for k in (-1, 0, 1)))))
    return a.join(b, ["code", "_bin"]).withColumn("gap", F.abs(F.datediff(F.col(date), F.col("date")))).where(F.col("gap") <= days).drop("_bin")


def eligible(claims: DataFrame, codes: DataFrame) -> DataFrame:
    """Claims that are checked: kinds R, M and H, and K with a topic, whose text names no other known code before their own; with their
    topics. claims (fid, code, date, kind, text)."""
    c = claims.withColumn("topics", topic_bits(F.col("text"))).where(F.col("kind").isin("R", "M", "H") | ((F.col("kind") == "K") & (F.col("topics") != 0)))
    named = c.select("fid", "code", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{4})\b"), F.lit(1))).alias("place", "named"))
    first = named.join(codes.select(F.col("code").alias("named")).distinct(), "named").groupBy("fid", "code").agg(F.min_by("named", "place").alias("first"))
    return c.join(first, ["fid", "code"], "left").where(F.coalesce(F.col("first") == F.col("code"), F.lit(True))).drop("first")


def disclosure_support(claims: DataFrame, disclosures: DataFrame, days: int = 45) -> DataFrame:
    """For each eligible claim (fid, code) the nearest disclosure that is no routine one and whose category and text both carry one of
    the claim's corporate actions (support), and the nearest of any other kind (other): structs (gap, date, ref). disclosures (code,
    date, status, categories, text, ref). What a disclosure can support is told once a disclosure, as topic bits."""
    carries = F.lit(0).cast("bigint")
    patterns = dict(rules.TOPIC_PATTERNS)
    for name, categories in rules.TOPIC_CATEGORIES.items():
        fits = F.arrays_overlap("categories", F.array(*map(F.lit, categories))) & F.col("text").rlike(patterns[name])
        carries = carries + F.when(fits, F.lit(BIT[name])).otherwise(F.lit(0))
    d = disclosures.where(F.coalesce(F.col("status") != "rutin", F.lit(True))).select("code", F.col("date").alias("disclosed"), "ref", carries.alias("carries"), (F.size(F.array_except("categories", F.array(F.lit("rutin")))) > 0).alias("told"))
    # Claims of one code, day and topics have one answer, and of disclosures alike only the first can be it; so what meets grows with days.
    d = d.groupBy("code", "disclosed", "carries", "told").agg(F.min(F.struct("ref")).alias("ref")).withColumn("ref", F.col("ref.ref"))
    at = F.struct("gap", F.col("disclosed").alias("date"), "ref")
    asked = claims.select("fid", "code", "date", "topics")
    j = _near(asked.select("code", "date", "topics").distinct(), d, days, "disclosed")
    matches = F.col("topics").bitwiseAND(F.col("carries")) != 0
    found = j.groupBy("code", "date", "topics").agg(F.min(F.when(matches, at)).alias("support"), F.min(F.when(F.col("told"), at)).alias("other"))
    return asked.join(found, ["code", "date", "topics"]).groupBy("fid", "code").agg(F.min("support").alias("support"), F.min("other").alias("other"))


def mention_support(claims: DataFrame, mentions: DataFrame, days: int = 180) -> DataFrame:
    """For claims of a change of control the nearest share deal in which another issuer's announcement names their code: rows (fid, code,
    mention: struct(gap, date, doc, line)). mentions: those of scan_mentions."""
    m = mentions.where("relation = 'transaksi_saham'").select("code", F.col("date").alias("told"), "doc", "line")
    wanted = claims.where(F.col("topics").bitwiseAND(F.lit(mask(rules.CONTROL_TOPICS))) != 0).select("fid", "code", "date")
    return _near(wanted, m, days, "told").groupBy("fid", "code").agg(F.min(F.struct("gap", F.col("told").alias("date"), "doc", "line")).alias("mention"))


def named_holders(claims: DataFrame, holders: DataFrame, most: int = 10) -> DataFrame:
    """Holders of a claim's code that its text names by a distinctive word of their name: four signs at least, not the code, not a word
    that tells no party apart, and in the names of `most` holders at most. holders (code, place, name), place: their order. Rows (fid,
    code, place, name)."""
    words = holders.select("code", "place", "name", F.explode(F.array_distinct(F.split(party_key("name"), " "))).alias("word"))
    rare = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("word")
    telling = words.where((F.length("word") >= 4) & (F.col("word") != F.col("code")) & ~F.col("word").isin(rules.GENERIC_TOKENS)).join(rare, "word", "left_semi")
    said = claims.select("fid", "code", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"([A-Z0-9]+)"), F.lit(1)))).alias("word"))
    return said.join(telling, ["code", "word"]).select("fid", "code", "place", "name").distinct()


def holder_trends(positions: DataFrame, usable: DataFrame) -> DataFrame:
    """positions (code, name, period, pct, shares), usable (code, period): for each holder its last observed period and percent, and the
    direction of its shares over its last three observations in usable periods (null if level or unknown)."""
    p = positions.where("pct IS NOT NULL").join(usable.select("code", "period").distinct(), ["code", "period"], "left_semi")
    w = Window.partitionBy("code", "name").orderBy(F.desc("period"))
    last = p.withColumn("_k", F.row_number().over(w)).where("_k <= 3")
    g = last.groupBy("code", "name").agg(F.max_by("shares", "period").alias("to"), F.min_by("shares", "period").alias("from"), F.max("period").alias("last"), F.max_by("pct", "period").alias("last_pct"), F.count("*").alias("n"))
    known = (F.col("n") >= 2) & (F.col("from") != 0) & (F.col("to") != 0) & (F.col("from") != F.col("to"))
    return g.select("code", "name", "last", "last_pct", F.when(known, F.when(F.col("to") > F.col("from"), "up").otherwise("down")).alias("direction"))


def holder_verdicts(claims: DataFrame, named: DataFrame, trends: DataFrame) -> DataFrame:
    """A verdict for each named holder with observations: contradicted where the claim says sold but the shares rose, or bought but they
    fell, and the claim is not of a later month than the last observation; else recorded. In the holders' order, up to the recorded one
    by which there are two. Rows (fid, code, place, verdict, ref, name, direction)."""
    c = claims.select("fid", "code", F.trunc("date", "month").alias("month"), F.col("text").rlike(rules.SELL).alias("sells"), F.col("text").rlike(rules.BUY).alias("buys"))
    j = named.join(trends, ["code", "name"]).join(c, ["fid", "code"])
    against = (F.col("month") <= F.trunc("last", "month")) & ((F.col("sells") & ~F.col("buys") & (F.col("direction") == "up")) | (F.col("buys") & ~F.col("sells") & (F.col("direction") == "down")))
    j = j.withColumn("verdict", F.when(against, CONTRADICTED).otherwise(RECORDED))
    w = Window.partitionBy("fid", "code").orderBy("place", "name")
    j = j.withColumn("_n", F.row_number().over(w)).withColumn("_full", ((F.col("verdict") == RECORDED) & (F.col("_n") >= 2)).cast("int"))
    past = F.coalesce(F.sum("_full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return j.withColumn("_past", past).where("_past = 0").select("fid", "code", F.col("_n").alias("place"), "verdict", F.date_format("last", "yyyy-MM").alias("ref"), "name", "direction")


def check_claims(claims: DataFrame, codes: DataFrame, disclosures: DataFrame, mentions: DataFrame, holders: DataFrame, positions: DataFrame, usable: DataFrame, covered: DataFrame, days: int = 45) -> DataFrame:
    """The verdicts of each eligible claim, four at most: rows (fid, code, place, verdict, source, ref).

    In this order: a disclosure of the same issuer, topic and time supports it; for a change of control so does another issuer's share
    deal that names the code; named holders contradict or record it. Without support: another disclosure near is told; a corporate action
    can't be checked where the covered days (covered: day) end before it or two working days within a week are missing, and has no basis
    where they don't and nothing else was disclosed; a claim on holdings that no holder answered can't be checked after the last observed
    month. Claims, codes and tables may hold nulls and repeats: a claim without date meets nothing, equal (fid, code) count as one claim.
    Empty tables give the verdicts that don't need them."""
    c = eligible(claims.dropDuplicates(["fid", "code"]), codes)
    found = disclosure_support(c, disclosures, days)
    told = mention_support(c, mentions, 4 * days)
    held = holder_verdicts(c, named_holders(c, holders), holder_trends(positions, usable))
    action, holding = F.col("topics").bitwiseAND(F.lit(mask(rules.ACTION_TOPICS))) != 0, F.col("topics").bitwiseAND(F.lit(mask(["kepemilikan"]))) != 0
    by_holders = held.groupBy("fid", "code").agg(F.array_sort(F.collect_list(F.struct("place", "verdict", F.lit("holders").alias("source"), "ref"))).alias("by_holders"))
    gaps = _near(c.where(action).select("fid", "code", "date").withColumn("_code", F.col("code")).withColumn("code", F.lit("")), missing_weekdays(covered).withColumn("code", F.lit("")), 7, "day")
    gaps = gaps.groupBy("fid", F.col("_code").alias("code")).agg(F.count("*").alias("gaps"))
    ends = covered.agg(F.max("day").alias("last_day")).crossJoin(positions.agg(F.max("period").alias("last_period")))
    c = c.select("fid", "code", "date", "topics").join(found, ["fid", "code"], "left").join(told, ["fid", "code"], "left").join(by_holders, ["fid", "code"], "left").join(gaps, ["fid", "code"], "left").join(F.broadcast(ends))
    row = lambda verdict, source, ref: F.struct(F.lit(verdict).alias("verdict"), F.lit(source).alias("source"), ref.cast("string").alias("ref"))
    support, mention, other = F.col("support").isNotNull(), F.col("mention").isNotNull(), F.col("other").isNotNull()
    open_ = ~support & ~mention
    uncovered = F.coalesce(F.col("date") > F.col("last_day"), F.lit(False)) | (F.coalesce("gaps", F.lit(0)) >= 2)
    late = F.coalesce(F.trunc("date", "month") > F.trunc("last_period", "month"), F.lit(False))
    each = [
        F.when(support, row(SUPPORTED, "disclosure", F.col("support.ref"))),
        F.when(mention, row(SUPPORTED, "mention", F.concat_ws("#", "mention.doc", F.col("mention.line").cast("string")))),
    ]
    after = [
        F.when(open_ & other, row(OTHER, "disclosure", F.col("other.ref"))),
        F.when(open_ & action & uncovered, row(NOT_CHECKABLE, "coverage", F.col("date"))).when(open_ & action & ~other, row(NO_BASIS, "coverage", F.col("date"))),
        F.when(open_ & holding & F.col("by_holders").isNull() & late, row(NOT_CHECKABLE, "coverage", F.date_format("last_period", "yyyy-MM"))),
    ]
    middle = F.transform(F.coalesce("by_holders", F.array().cast("array<struct<place:int,verdict:string,source:string,ref:string>>")), lambda x: F.struct(x["verdict"].alias("verdict"), x["source"].alias("source"), x["ref"].alias("ref")))
    all_rows = F.slice(F.concat(F.array_compact(F.array(*each)), middle, F.array_compact(F.array(*after))), 1, MOST)
    return c.select("fid", "code", F.posexplode(all_rows).alias("place", "v")).select("fid", "code", (F.col("place") + 1).alias("place"), "v.verdict", "v.source", "v.ref")


def missing_weekdays(covered: DataFrame) -> DataFrame:
    """Monday to Friday between the first and the last covered day that are not covered."""
    span = covered.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    days = span.select(F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    return days.join(covered.select("day").distinct(), "day", "left_anti")
