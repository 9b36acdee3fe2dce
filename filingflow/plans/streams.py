"""Registered queries on the event table (W): the stream operators over the whole table as a static frame, with DuckDB SQL. The tests
run the same operators on a file stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from filingflow.plans.registry import Registry
from filingflow.plans.tables import table
from filingflow.streaming import events as W

query = Registry()


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("W01_rate_flags", "WITH e AS (SELECT user_id, time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 10 SECOND * k AS s FROM events, range(0, 6) r(k)), g AS (SELECT s, CAST(user_id AS VARCHAR) AS who, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT s, NULL, count(*) FROM e GROUP BY s) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS \"start\", who, n FROM g WHERE n > CASE WHEN who IS NULL THEN 2 ELSE 1 END")
def w01(spark, d):
    return W.rate_flags(_events(spark, d), "user_id", "ts", 1, 2).withColumn("start", _text("start"))


@query("W02_quota_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, user_id, count(*) AS n FROM events GROUP BY ALL")
def w02(spark, d):
    return W.quota_counts(_events(spark, d), "user_id", "ts").withColumn("hour", _text("hour"))


@query("W04_sessions", "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS \"start\", count(*) AS turns, count(*) > 20 AS over_limit FROM s GROUP BY user_id, k")
def w04(spark, d):
    return W.sessions(_events(spark, d), "user_id", "ts").select("user_id", _text("start").alias("start"), "turns", "over_limit")


@query("W05_retain", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def w05(spark, d):
    return W.retain(_events(spark, d), "ts", 10, F.lit("2024-01-31").cast("timestamp")).select("event_id")


@query("W08_match_streams", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 2 DAY AND a.ts + INTERVAL 2 DAY")
def w08(spark, d):
    e = _events(spark, d)
    a = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("a_id"), F.col("ts").alias("t1"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), F.col("ts").alias("t2"))
    return W.match_streams(a, b, "user_id", "t1", "t2", 2).select("a_id", "b_id")


def _stream(spark, d):
    """The event table as a stream of files, and a new folder for its checkpoint and target."""
    e, sc = table(spark, d, "events"), spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-checkpoint-")
    return spark.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parq*"), f"{base.rstrip('/')}/filingflow-stream-{uuid.uuid4().hex}"


@query("W03_daily_budget", """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day, "value" AS v, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY epoch_ms(ts), event_id) AS n FROM events),
r AS (SELECT user_id, event_id, day, n, v <= 150 AS admitted, CASE WHEN v <= 150 THEN v ELSE 0 END AS used FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.day, e.n, used + v <= 150, CASE WHEN used + v <= 150 THEN used + v ELSE used END FROM r JOIN e ON e.user_id = r.user_id AND e.day = r.day AND e.n = r.n + 1)
SELECT CAST(user_id AS VARCHAR) AS key, event_id, CAST(day AS VARCHAR) AS day, admitted, used FROM r""")
def w03(spark, d):
    return W.daily_budget(_events(spark, d), "user_id", "ts", "event_id", "value", 150.0)


@query("W06_ingest", "SELECT user_id, event_type AS fingerprint FROM events GROUP BY ALL")
def w06(spark, d):
    """The table comes twice, by two streams; the second adds nothing."""
    for k in range(2):
        stream, folder = _stream(spark, d)
        target = folder if not k else target
        rows = stream.select("user_id", F.col("event_type").alias("fingerprint"))
        W.ingest(rows, f"{target}/table", f"{folder}/checkpoint", "user_id", first_batch=W.last_batch(spark, f"{target}/table")).awaitTermination()
    return spark.read.parquet(f"{target}/table").select("user_id", "fingerprint")


@query("W07_fold_stream", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) - 1 AS dups FROM events GROUP BY ALL")
def w07(spark, d):
    stream, folder = _stream(spark, d)
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    W.fold_stream(rows, f"{folder}/table", f"{folder}/checkpoint", ["user_id", "event_type"], "ts", "event_id").awaitTermination()
    found = W.folded(spark.read.parquet(f"{folder}/table"), ["user_id", "event_type"], "ts", "event_id")
    return found.select("user_id", "event_type", "event_id", _text("ts").alias("first"), "dups")


QUERIES, SQL = query.queries, query.sql
