"""Operators on event streams; each takes a streaming or a static frame with an event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def rate_flags(stream: DataFrame, key: str, time: str, per_key: int = 12, total: int = 120, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sliding windows in which a client or all clients together exceed their number; the client is null for all."""
    s = stream.withWatermark(time, delay)
    each = s.withColumn("who", F.explode(F.array(F.col(key).cast("string"), F.lit(None).cast("string"))))
    g = each.groupBy(F.window(time, window, slide), "who").agg(F.count("*").alias("n"))
    limit = F.when(F.col("who").isNull(), total).otherwise(per_key)
    return g.where(F.col("n") > limit).select(F.col("window.start").alias("start"), "who", "n")


def quota_counts(stream: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Events an hour of each client."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 hour"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), key, "n")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "1 hour", most: int = 20, delay: str = "2 hours") -> DataFrame:
    """Sessions of each client: events with no longer gap than `gap`; over_limit where there are more than `most`."""
    g = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("turns"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "turns", (F.col("turns") > most).alias("over_limit"))


def retain(stream: DataFrame, time: str, days: int, now: Column) -> DataFrame:
    return stream.where(F.col(time) >= now - F.expr(f"interval {days} days"))


class Allowance:
    """What a key has used of its day's cap so far."""

    def __init__(self, cap: float, day: str = "", used: float = 0.0):
        self.cap, self.day, self.used = cap, day, used

    def take(self, day: str, amount: float) -> tuple[bool, float]:
        """Whether an amount still fits into its day, and what is used then. A new day begins at nothing; a day that is over admits
        nothing. A null amount uses nothing."""
        if day > self.day:
            self.day, self.used = day, 0.0
        amount = 0.0 if amount != amount or amount is None else amount
        ok = day == self.day and self.used + amount <= self.cap
        self.used += amount if ok else 0.0
        return ok, self.used


BUDGET = "key string, event_id long, day string, admitted boolean, used double"


class _DailyBudget(StatefulProcessor):
    """State of a key: what is used of its day, and events that wait until the watermark has passed them. So the order in which events
    arrive decides nothing as long as none comes later than the delay."""

    def __init__(self, cap: float):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("used", "day string, used double")
        self.waiting = handle.getListState("waiting", "ms long, event_id long, amount double")

    def _settle(self, key, until: int) -> pd.DataFrame:
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= until], [r for r in rows if r[0] > until]
        if due:
            allowance = Allowance(self.cap, *(self.state.get() if self.state.exists() else ("", 0.0)))
            out = []
            for ms, event_id, amount in due:
                day = str(pd.Timestamp(ms, unit="ms").date())
                out.append((key[0], event_id, day, *allowance.take(day, amount)))
            self.state.update((allowance.day, allowance.used))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        else:
            out = []
        if rest:
            self.handle.registerTimer(rest[0][0])
        return pd.DataFrame(out, columns=["key", "event_id", "day", "admitted", "used"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([(int(r.ts.value // 1_000_000), int(r.event_id), float(r.amount)) for r in frame.itertuples()])
        yield self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def daily_budget(events: DataFrame, key: str, time: str, id_col: str, amount: str, cap: float, delay: str = "1 hour") -> DataFrame:
    """Each event with whether it fits into its key's budget of the day (UTC), in order of time (to the millisecond), then id. In a stream
    an event is settled once the watermark, the latest time less the delay, has passed it, and events that come later than that are
    dropped; a static table is settled whole, its keys passing through sorted partitions one row at a time."""
    s = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(id_col).cast("long").alias("event_id"), F.col(amount).cast("double").alias("amount")).where("ts IS NOT NULL")
    if events.isStreaming:
        return s.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(_DailyBudget(cap), BUDGET, "append", "EventTime")
    ordered = s.select("key", F.unix_millis("ts").alias("ms"), "event_id", "amount").repartition("key").sortWithinPartitions("key", "ms", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, allowance = object(), Allowance(cap)
        for batch in batches:
            keys, ms, ids, amounts = (c.to_pylist() for c in batch.columns)
            days = np.array(ms, "datetime64[ms]").astype("datetime64[D]").astype(str).tolist()
            out = []
            for k, day, amount in zip(keys, days, amounts):
                if k != last:
                    last, allowance = k, Allowance(cap)
                out.append(allowance.take(day, float("nan") if amount is None else amount))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(days, pa.string()), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.float64())], ["key", "event_id", "day", "admitted", "used"])

    return ordered.mapInArrow(run, BUDGET)


def dedupe_stream(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first event of each key; later ones within the delay are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def match_streams(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, days: int) -> DataFrame:
    """Pairs of one key that are at most so many days apart, either way; state of both sides is dropped after that time."""
    a, b = left.withWatermark(left_time, "1 day"), right.withWatermark(right_time, "1 day")
    near = (F.col(f"b.{right_time}") >= F.col(f"a.{left_time}") - F.expr(f"interval {days} days")) & (F.col(f"b.{right_time}") <= F.col(f"a.{left_time}") + F.expr(f"interval {days} days"))
    return a.alias("a").join(b.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)


def _table(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """A table of batches; empty before the first one. The schema is given, so that no file has to be read to tell it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", target).parquet(target)


def _earlier(batch: DataFrame, batch_id: int, target: str, schema: T.StructType) -> DataFrame:
    """What earlier batches wrote into the buckets that this one touches: other buckets' files aren't read, and what a failed run of this
    batch may have left counts for nothing."""
    touched = [r.bucket for r in batch.select("bucket").distinct().collect()]
    return _table(batch.sparkSession, target, schema).where(F.col("bucket").isin(touched) & (F.col("batch") < batch_id))


def _commit(rows: DataFrame, batch_id: int, target: str) -> None:
    """Write a batch into folders of its own, replacing what an earlier run of it wrote."""
    rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(target)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str, buckets: int = 64, first_batch: int = 0):
    """Adds rows with a new (key, fingerprint) to a Parquet table, each once. A batch commits under its number: one that died half-way and
    comes again replaces its own files, and looks up only the buckets of the table that its keys fall into. first_batch: where a stream
    with a new checkpoint goes on numbering. Null keys and fingerprints are values like others."""
    schema = T.StructType([*stream.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        number = first_batch + batch_id
        rows = batch.dropDuplicates([key, "fingerprint"]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        known = _earlier(rows, number, target, schema).select(F.col(key).alias("_key"), F.col("fingerprint").alias("_fingerprint"), F.col("bucket").alias("_bucket"))
        same = (F.col("bucket") == F.col("_bucket")) & F.col(key).eqNullSafe(F.col("_key")) & F.col("fingerprint").eqNullSafe(F.col("_fingerprint"))
        _commit(rows.join(known, same, "left_anti"), number, target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_batch(spark: SparkSession, target: str) -> int:
    """The number after the last batch of a table; 0 without a table."""
    rows = _table(spark, target, T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())]))
    found = rows.agg(F.max("batch").alias("m")).first().m
    return 0 if found is None else found + 1


def fold_stream(stream: DataFrame, target: str, checkpoint: str, keys: list[str], time: str, id_col: str, buckets: int = 64):
    """Claims with equal keys as one: writes every row once, with the id of the first claim of its keys that had come by then, and
    whether it is a late duplicate: one that came after its first claim but is older. Duplicates and late rows are the side output;
    `folded` gives from the table what all rows in order of time would have given. State is the table, looked up by bucket."""
    columns = [*keys, id_col, time]
    schema = T.StructType([*stream.select(*columns).schema.fields, T.StructField("first_id", stream.schema[id_col].dataType), T.StructField("late", T.BooleanType()), T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*columns).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        before = _earlier(rows, batch_id, target, schema).where(F.col(id_col) == F.col("first_id")).select("bucket", *(F.col(k).alias(f"_{k}") for k in keys), F.col(id_col).alias("_id"), F.col(time).alias("_time"))
        w = Window.partitionBy("bucket", *keys).orderBy(time, id_col)
        j = rows.join(before.withColumnRenamed("bucket", "_bucket"), (F.col("bucket") == F.col("_bucket")) & same_keys(keys), "left").withColumn("_here", F.first(id_col).over(w))
        _commit(j.select(*columns, F.coalesce("_id", "_here").alias("first_id"), F.coalesce(F.col(time) < F.col("_time"), F.lit(False)).alias("late"), "bucket"), batch_id, target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def same_keys(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def folded(table: DataFrame, keys: list[str], time: str, id_col: str) -> DataFrame:
    """Of the rows that fold_stream wrote: the first claim of each key by time and id, how many others it has, and how many came late."""
    first = F.min_by(F.struct(id_col, time), F.struct(time, id_col)).alias("x")
    return table.groupBy(*keys).agg(first, (F.count("*") - 1).alias("dups"), F.sum(F.col("late").cast("long")).alias("late")).select(*keys, f"x.{id_col}", f"x.{time}", "dups", "late")
