"""Generic operators that the domain operators are made of."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, value: str, tolerance_days: int | None = None) -> DataFrame:
    """left with the last value of right at or before its date, if not older than the tolerance. One union and one window instead of
    a range join, so the cost is a sort; of several values on one date the highest counts."""
    last = right.groupBy(*keys, F.col(right_date).alias("_date")).agg(F.max(value).alias("_value"))
    a = left.select(*keys, F.col(left_date).alias("_date"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(last.schema["_value"].dataType).alias("_value"), F.lit(1).alias("_side"))
    b = last.select(*keys, "_date", F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "_value", F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("_date", "_side")
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_date", "_value")), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("_seen", seen).where("_side = 1")
    ok = F.lit(True) if tolerance_days is None else F.datediff(F.col("_date"), F.col("_seen._date")) <= tolerance_days
    return out.select("_row.*", F.when(ok, F.col("_seen._value")).alias(value), F.when(ok, F.col("_seen._date")).alias(f"{value}_date"))


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_date: str, right_date: str, days: int, tie: str) -> DataFrame:
    """left with its nearest row of right within so many days, before or after. Dates fall into bins as wide as the window, and each
    right row goes to three bins, so that the join is an equi-join; ties go to the earlier date, then the smaller `tie`."""
    bin_of = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) / F.lit(days))
    a = left.withColumn("_bin", bin_of(left_date))
    b = right.withColumn("_bin", F.explode(F.array(*(bin_of(right_date) + k for k in (-1, 0, 1)))))
    gap = F.abs(F.datediff(F.to_date(right_date), F.to_date(left_date)))
    near = a.join(b, [*keys, "_bin"]).withColumn("gap", gap).where(F.col("gap") <= days)
    w = Window.partitionBy(left_id).orderBy("gap", right_date, tie)
    return near.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_bin")


def overlap_join(left: DataFrame, ranges: DataFrame, start: str, end: str, low: str, high: str, keys: list[str] = [], width: int = 31) -> DataFrame:  # noqa: B006
    """Pairs of rows whose date spans overlap. Spans are cut into pieces of `width` days that are joined by piece; a pair is kept in
    the piece where the later of the two begins, so it comes once."""
    piece = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / F.lit(width))
    a = left.where(F.col(start) <= F.col(end)).withColumn("_piece", F.explode(F.sequence(piece(start), piece(end))))
    b = ranges.where(F.col(low) <= F.col(high)).withColumn("_piece", F.explode(F.sequence(piece(low), piece(high))))
    later = F.greatest(F.col(start), F.col(low))
    own = F.floor(F.datediff(later, F.lit("1970-01-01").cast("date")) / F.lit(width)) == F.col("_piece")
    return a.join(b, [*keys, "_piece"]).where((F.col(start) <= F.col(high)) & (F.col(low) <= F.col(end)) & own).drop("_piece")


def overlap_classes(left: DataFrame, ranges: DataFrame, left_id: str, range_id: str, start: str, end: str, low: str, high: str, keys: list[str] = [], width: int = 31) -> DataFrame:  # noqa: B006
    """overlap_join without copies: rows (kind, a, b). Rows with equal keys and span are a class, named by its smallest id. kind left and
    range: row a is of class b, for every row; kind pair: class a of left overlaps class b of ranges. Two rows overlap when their
    classes do. So the output grows with rows and with pairs of different spans, of which a calendar has so many only."""

    def classes(df: DataFrame, key: str, a: str, b: str, kind: str) -> tuple[DataFrame, DataFrame]:
        c = df.groupBy(*keys, a, b).agg(F.min(key).alias("_class"))
        same = [df[k].eqNullSafe(c[k]) for k in [*keys, a, b]]
        return c, df.join(c, same).select(F.lit(kind).alias("kind"), df[key].alias("a"), c["_class"].alias("b"))

    a, members = classes(left, left_id, start, end, "left")
    b, others = classes(ranges, range_id, low, high, "range")
    pairs = overlap_join(a.withColumnRenamed("_class", "a"), b.withColumnRenamed("_class", "b"), start, end, low, high, keys, width)
    return members.unionByName(others).unionByName(pairs.select(F.lit("pair").alias("kind"), "a", "b"))


def explode_days(df: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    return df.where(F.col(start) <= F.col(end)).withColumn(day, F.explode(F.sequence(F.col(start), F.col(end))))


def drop_fully_covered(docs: DataFrame, covering: DataFrame, doc_id: str, start: str, end: str, day: str) -> DataFrame:
    """Documents with at least one day that nothing covers (relational division); documents without a span stay."""
    days = explode_days(docs.select(doc_id, start, end), start, end, day)
    open_days = days.join(covering.select(day).distinct(), day, "left_anti")
    without = docs.where(~F.coalesce(F.col(start) <= F.col(end), F.lit(False)))
    return docs.join(open_days.select(doc_id).distinct(), doc_id, "left_semi").unionByName(without)


def rank_pct(df: DataFrame, value: str, partition: list[str], out: str) -> DataFrame:
    """Share of the others below a value, ties counting half, in whole percent, half up. Counted by value first, so that the window
    runs over distinct values only; null values have no rank and don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*partition, value).agg(F.count("*").alias("_same"))
    w = Window.partitionBy(*partition).orderBy(value)
    below = F.sum("_same").over(w) - F.col("_same")
    total = F.sum("_same").over(Window.partitionBy(*partition))
    ranks = counts.select(*partition, value, F.floor((200 * below + 100 * F.col("_same") + total) / (2 * total)).cast("bigint").alias(out))
    return df.join(ranks, [*partition, value], "left")


def sum_strict(col: str) -> Column:
    """A sum that is null as soon as one value isn't known."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))


def first_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in an order; Spark keeps only k rows a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def find_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Names that differ in case only or not at all."""
    return df.groupBy(F.lower(key).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def fold_duplicates(df: DataFrame, keys: list[str], order: list[Column], id_col: str) -> DataFrame:
    """The first row of each key with the ids of the others, in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w))
    others = ranked.where("_rank > 1").groupBy(*keys).agg(F.array_sort(F.collect_list(id_col)).alias("dups"))
    first = ranked.where("_rank = 1").drop("_rank")
    same = [first[k].eqNullSafe(others[k]) for k in keys]
    joined = first.join(others, same, "left").select(first["*"], others["dups"])
    return joined.withColumn("dups", F.coalesce("dups", F.array().cast(joined.schema["dups"].dataType)))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that the cluster names in spark.checkpoint.dir (a local one where none is set)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): the smallest node that each node is connected with. Each round every node takes the smallest root among its
    neighbours', then the root of that root, until nothing changes."""
    both = checkpointed(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct())
    now = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))
    while True:
        now = checkpointed(now)
        near = both.join(now.select(F.col("node").alias("other"), F.col("root").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = now.join(near, "node").select("node", F.least("root", "near").alias("root"))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = checkpointed(step.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root")))
        if new.exceptAll(now).isEmpty():
            return new
        now = new
