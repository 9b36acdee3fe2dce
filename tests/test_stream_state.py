"""Streams with state: several orders of arrival, restarts, batches that fail half-way and come again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from filingflow.streaming import events as W

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def fed(spark, folder, schema, parts, start):
    """Feed parts one file after the other; the query is stopped and started again in between."""
    (folder / "in").mkdir(parents=True)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        start(spark.readStream.schema(schema).parquet(str(folder / "in"))).awaitTermination()


SPEND = "who string, ts timestamp, event_id long, amount double"


@pytest.mark.parametrize("seed", [1, 2])
def test_daily_budget_over_restarts_and_orders(spark, rocks, tmp_path, seed):
    rng = random.Random(seed)
    begin = dt.datetime(2026, 1, 1, 12)
    rows = [(rng.choice("ab"), begin + dt.timedelta(minutes=17 * k), k, float(rng.randint(1, 40))) for k in range(150)]
    rows[7] = ("a", rows[7][1], 7, None)
    # Within half a day, rows arrive in any order; the delay is a day. A last row lets the watermark pass all others.
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.uniform(0, 12)))
    parts = [arrival[:60], arrival[60:100], arrival[100:], [("z", begin + dt.timedelta(days=90), 999, 1.0)], [("z", begin + dt.timedelta(days=91), 1000, 1.0)]]
    sink = lambda s: W.daily_budget(s, "who", "ts", "event_id", "amount", 100.0, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    fed(spark, tmp_path, SPEND, parts, sink)
    streamed = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("key <> 'z'").collect()))
    batch = sorted(map(tuple, W.daily_budget(spark.createDataFrame(rows, SPEND), "who", "ts", "event_id", "amount", 100.0).collect()))
    want, used = [], {}
    for who, ts, k, amount in sorted(rows, key=lambda r: (r[1], r[2])):
        day = str(ts.date())
        ok = used.get((who, day), 0.0) + (amount or 0.0) <= 100.0
        used[who, day] = used.get((who, day), 0.0) + (amount or 0.0) * ok
        want.append((who, k, day, ok, used[who, day]))
    assert batch == sorted(want) and streamed == batch
    assert W.daily_budget(spark.createDataFrame([], SPEND), "who", "ts", "event_id", "amount", 1.0).count() == 0


def test_ingest_replays_a_failed_batch(spark, tmp_path):
    schema, target = "id long, fingerprint string, extra int", str(tmp_path / "t")
    rows = [(k % 40, f"f{k % 3}", k) for k in range(200)] + [(None, None, 1), (None, None, 2)]
    fed(spark, tmp_path / "a", schema, [rows[:80], rows[60:]], lambda s: W.ingest(s, target, str(tmp_path / "cp"), "id", 8))
    distinct = {(r[0], r[1]) for r in rows}
    table = lambda: spark.read.parquet(target)
    assert table().count() == len(distinct) == table().select("id", "fingerprint").distinct().count()
    # The last batch dies: part of its files are there, and its commit is not in the log. It runs again.
    found = sorted(map(tuple, table().select("id", "fingerprint").collect()), key=str)
    (tmp_path / "cp" / "commits" / "1").unlink()
    for f in (tmp_path / "cp" / "commits").glob(".1.crc"):
        f.unlink()
    import shutil

    shutil.rmtree(next((tmp_path / "t" / "batch=1").glob("bucket=*")))
    W.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "a" / "in")), target, str(tmp_path / "cp"), "id", 8).awaitTermination()
    assert sorted(map(tuple, table().select("id", "fingerprint").collect()), key=str) == found
    # Another stream with a checkpoint of its own goes on after the last batch and adds nothing it has seen.
    number = W.last_batch(spark, target)
    fed(spark, tmp_path / "b", schema, [[*rows[:50], (77, "new", 0)]], lambda s: W.ingest(s, target, str(tmp_path / "cp2"), "id", 8, number))
    assert table().count() == len(distinct) + 1 and number == 2
    assert W.last_batch(spark, str(tmp_path / "none")) == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folding_over_orders_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    schema, target = "code string, norm string, fid long, ts timestamp", str(tmp_path / "t")
    begin = dt.datetime(2026, 1, 1)
    rows = [(rng.choice(["A", "B", None]), f"t{rng.randint(0, 9)}", k, begin + dt.timedelta(hours=rng.randint(0, 50))) for k in range(120)]
    fed(spark, tmp_path / "s", schema, [rows[:50], rows[50:60], rows[60:]], lambda s: W.fold_stream(s, target, str(tmp_path / "cp"), ["code", "norm"], "ts", "fid", 4))
    table = spark.read.parquet(target)
    assert sorted(r.fid for r in table.collect()) == list(range(120))
    got = {(r.code, r.norm): (r.fid, r.ts, r.dups) for r in W.folded(table, ["code", "norm"], "ts", "fid").collect()}
    want = {}
    for code, norm, fid, ts in sorted(rows, key=lambda r: (r[3], r[2])):
        first = want.get((code, norm))
        want[code, norm] = (fid, ts, 0) if first is None else (*first[:2], first[2] + 1)
    assert got == want
    # The side output: what came after its first claim although it is older, by arrival.
    late, firsts = set(), {}
    for part in (rows[:50], rows[50:60], rows[60:]):
        here = {}
        for code, norm, fid, ts in sorted(part, key=lambda r: (r[3], r[2])):
            if (code, norm) in firsts and ts < firsts[code, norm]:
                late.add(fid)
            here.setdefault((code, norm), ts)
        firsts = here | firsts
    assert {r.fid for r in table.where("late").collect()} == late and late
    assert table.where(F.col("fid") == F.col("first_id")).count() == len(want)
