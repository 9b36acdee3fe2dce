"""Structure of holdings: concentration, breadth, flow, comparison of periods. Holdings are rows (entity, party, period, shares,
pct); a party that is not listed is not observed, which is not the same as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions.text import parse_local
from filingflow.operators.relational import first_per, rank_pct


def structure(positions: DataFrame, pooled: DataFrame) -> DataFrame:
    """Per entity and period: holders, total percent, rest, Herfindahl index, effective number of holders, largest, percent of
    unpooled holders of 1 to 5, and the average of holders below the largest, in whole millionths."""
    p = positions.join(pooled.select("party", F.lit(True).alias("pooled")), "party", "left")
    small = F.coalesce(~F.col("pooled"), F.lit(True)) & (F.col("pct") >= 1) & (F.col("pct") < 5)
    # Percent in whole millionths: sums are exact, whatever their order.
    u = F.round(F.col("pct") * 1000000).cast("bigint")
    g = p.groupBy("entity", "period").agg(F.count("*").alias("n"), F.sum(u).alias("units"), F.max(u).alias("top_units"), F.sum(u * u).alias("squares"), F.sum(F.when(small, u).otherwise(0)).alias("shadow"))
    hhi = F.col("squares") / 1e12
    average = F.when(F.col("n") > 1, F.floor((F.col("units") - F.col("top_units")) / (F.col("n") - 1)))
    return g.select("entity", "period", "n", (F.col("units") / 1000000.0).alias("total"), ((100000000 - F.col("units")) / 1000000.0).alias("rest"), hhi.alias("hhi"), F.round(10000 / hhi, 4).alias("effective_n"), (F.col("top_units") / 1000000.0).alias("top"), (F.col("shadow") / 1000000.0).alias("shadow"), (average / 1000000.0).alias("avg_rest"))


def with_percentile(structures: DataFrame, column: str) -> DataFrame:
    """Where an entity's value stands among all entities of the period."""
    return rank_pct(structures, column, ["period"], f"{column}_rank")


def implied_total(positions: DataFrame) -> DataFrame:
    """Total shares that holdings imply: the upper median of shares / percent * 100."""
    each = positions.where("pct > 0 and shares > 0").select("entity", "period", F.round(F.col("shares") / F.col("pct") * 100, 2).alias("x"))
    return each.groupBy("entity", "period").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("entity", "period", F.get("xs", F.floor(F.size("xs") / 2).cast("int")).alias("implied"))


def party_counts(positions: DataFrame, axis: DataFrame) -> DataFrame:
    """Holders per entity on every period of the axis, null where the entity has none."""
    counts = positions.groupBy("entity", "period").agg(F.count("*").alias("holders"))
    dense = positions.select("entity").distinct().join(F.broadcast(axis), how="cross")
    return dense.join(counts, ["entity", "period"], "left")


def period_axis(positions: DataFrame, least: int) -> DataFrame:
    """Every month from the first to the last that at least so many entities report."""
    ends = positions.groupBy("period").agg(F.countDistinct("entity").alias("n")).where(F.col("n") >= least).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    return ends.select(F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"), F.expr("interval 1 month"))).alias("period"))


def breadth(counts: DataFrame, lags: list[int]) -> DataFrame:
    """Change of the number of holders over exactly k periods; counts are dense."""
    w = Window.partitionBy("entity").orderBy("period")
    return counts.select("entity", "period", "holders", *((F.col("holders") - F.lag("holders", k).over(w)).alias(f"change_{k}") for k in lags))


def recent_valid(counts: DataFrame, back: int) -> DataFrame:
    """The last known number of holders, at most so many periods back; counts are dense."""
    w = Window.partitionBy("entity").orderBy("period").rowsBetween(-back, 0)
    return counts.select("entity", "period", F.last("holders", ignorenulls=True).over(w).alias("holders"))


def diff_periods(positions: DataFrame, first: str, second: str) -> DataFrame:
    """Parties of two periods side by side; a difference only where both know the party."""
    side = lambda day, k: positions.where(F.col("period") == F.lit(day).cast("date")).select("entity", "party", F.col("shares").alias(f"shares_{k}"), F.col("pct").alias(f"pct_{k}"))
    both = side(first, "a").join(side(second, "b"), ["entity", "party"], "full")
    status = F.when(F.col("pct_a").isNull(), "new").when(F.col("pct_b").isNull(), "gone").otherwise("both")
    return both.select("entity", "party", "shares_a", "shares_b", (F.col("shares_b") - F.col("shares_a")).alias("change"), F.round(F.col("pct_b") - F.col("pct_a"), 4).alias("points"), status.alias("status"))


def flow(positions: DataFrame, pooled: DataFrame, first: str, second: str) -> DataFrame:
    """Shares that common unpooled holders gained, in percent of the implied total, against the change of the number of holders:
    accumulation if they gain a point while holders fall by 5 %, distribution the other way round."""
    a, b = (positions.where(F.col("period") == F.lit(d).cast("date")) for d in (first, second))
    common = a.join(b.select("entity", "party", F.col("shares").alias("after")), ["entity", "party"]).join(pooled, "party", "left_anti")
    gain = common.groupBy("entity").agg(F.sum(F.col("after") - F.col("shares")).alias("gain"))
    n = a.groupBy("entity").agg(F.count("*").alias("n_a")).join(b.groupBy("entity").agg(F.count("*").alias("n_b")), "entity")
    out = gain.join(implied_total(b).select("entity", "implied"), "entity").join(n, "entity")
    block, holders = F.round(100 * F.col("gain") / F.col("implied"), 4), F.round(100.0 * (F.col("n_b") - F.col("n_a")) / F.col("n_a"), 4)
    out = out.select("entity", block.alias("block"), holders.alias("holders"))
    return out.withColumn("kind", F.when((F.col("block") >= 1) & (F.col("holders") <= -5), "accumulation").when((F.col("block") <= -1) & (F.col("holders") >= 5), "distribution").otherwise("neutral"))


def report_pair(reports: DataFrame, start: str, end: str) -> DataFrame:
    """Per entity the last report up to `end`, and to compare it with the last one up to `start`, else the first one after it."""
    p = F.col("period")
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    g = reports.groupBy("entity").agg(F.max(F.when(p <= b, p)).alias("latest"), F.max(F.when(p <= a, p)).alias("before"), F.min(F.when((p > a) & (p <= b), p)).alias("inside"))
    return g.select("entity", "latest", F.coalesce("before", "inside").alias("compared"))


def count_change(reports: DataFrame, start: str, end: str) -> DataFrame:
    """Change of the number of holders between the two reports; only known counts above zero."""
    pair = report_pair(reports, start, end)
    n = reports.where("holders > 0").select("entity", "period", "holders")
    a = n.select("entity", F.col("period").alias("compared"), F.col("holders").alias("holders_a"))
    b = n.select("entity", F.col("period").alias("latest"), F.col("holders").alias("holders_b"))
    return pair.join(a, ["entity", "compared"]).join(b, ["entity", "latest"]).select("entity", "compared", "latest", "holders_a", "holders_b", (F.col("holders_b") - F.col("holders_a")).alias("change"))


SORTS = {"largest": [F.desc_nulls_last, "total_b"], "up": [F.desc_nulls_last, "change"], "down": [F.asc_nulls_last, "change"], "holders_up": [F.desc_nulls_last, "holders"], "holders_down": [F.asc_nulls_last, "holders"], "code": [F.asc, "entity"]}


def rank_changes(structures: DataFrame, first: str, second: str, mode: str, k: int = 100) -> DataFrame:
    """Entities by the change of their total or holders between two periods, in one of six orders; the first k."""
    side = lambda day, s: structures.where(F.col("period") == F.lit(day).cast("date")).select("entity", F.col("total").alias(f"total_{s}"), F.col("n").alias(f"n_{s}"))
    both = side(first, "a").join(side(second, "b"), "entity", "full").select("entity", "total_b", (F.round((F.col("total_b") - F.col("total_a")) * 1000000).cast("bigint") / 1000000.0).alias("change"), (F.col("n_b") - F.col("n_a")).alias("holders"))
    how, column = SORTS[mode]
    return both.orderBy(how(column), "entity").limit(k)


def snapshot_issues(positions: DataFrame) -> DataFrame:
    """What is wrong with a period's list: nothing listed above zero, a party twice, percent out of range, shares missing, total above 100.05."""
    g = positions.groupBy("entity", "period").agg(F.count("*").alias("n"), F.countDistinct("party").alias("parties"), F.sum("pct").alias("total"), F.bool_or((F.col("pct") < 0) | (F.col("pct") > 100)).alias("range"), F.bool_or(F.col("shares").isNull() | (F.col("shares") < 0)).alias("shares"))
    found = F.array_compact(F.array(F.when(F.col("n") != F.col("parties"), F.lit("duplicate")), F.when(F.col("range"), F.lit("range")), F.when(F.col("shares"), F.lit("shares")), F.when(F.round("total", 4) > 100.05, F.lit("total"))))
    return g.select("entity", "period", F.array_join(found, ",").alias("issues"))


def latest_holders(positions: DataFrame, k: int) -> DataFrame:
    """The k largest holders of each entity in its last period."""
    last = positions.groupBy("entity").agg(F.max("period").alias("period"))
    return first_per(positions.join(last, ["entity", "period"]), ["entity"], [F.desc("pct"), F.asc("party")], k)


def natural_key(text: Column) -> Column:
    """Parts of a text that compare as a reader would: runs of digits by their value, letters without case and marks."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    value = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)), lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(value(p)).cast("string"), 9, "0"), value(p))).otherwise(p))


def smart_order(column: str, tie: str, descending: bool = False) -> list[Column]:
    """Order of a column of mixed cells: numbers, as they are written here, by value and before texts, texts in natural order; the other
    way round if descending. Empty cells are last either way, and equal cells stay in order of the tie."""
    cell = F.trim(F.col(column).cast("string"))
    number, turned = parse_local(cell), F.desc if descending else F.asc
    empty = F.coalesce(cell == "", F.lit(True))
    return [F.asc(empty), turned(number.isNull()), turned(number), turned(F.when(number.isNull() & ~empty, natural_key(cell))), F.asc(tie)]


def sort_smart(df: DataFrame, column: str, tie: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*smart_order(column, tie, descending))
