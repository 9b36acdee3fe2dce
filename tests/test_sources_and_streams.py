"""Sources on files, and stream operators over a file stream against their static results."""

import json

import pytest
from pyspark.sql import functions as F

from filingflow.sources import files as S
from filingflow.streaming import events as W


def test_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name, body in (("a/x.md", "# é"), ("y.html", "<p>"), ("z.csv", "a,b"), ("n.txt", "no"), (".hidden/h.md", "no")):
        (tmp_path / name).write_text(body)
    assert {(r.name, r.kind, r.body) for r in S.read_documents(spark, str(tmp_path)).collect()} == {("x.md", "md", "# é"), ("y.html", "html", "<p>"), ("z.csv", "csv", "a,b")}


def test_indexes(spark, tmp_path):
    index = {"days": [{"d": "2026-01-02", "f": "b.md"}, {"d": "2026-01-01", "f": "a.md"}], "tickers": {"BBCA": [["0", "3"], ["9", "1"], ["1"]]}, "users": {"Budi": [["1", "2"]]}}
    (tmp_path / "i.json").write_text(json.dumps(index))
    assert [(r.key, str(r.date), r.file) for r in S.read_daily_index(spark, str(tmp_path / "i.json")).collect()] == [("BBCA", "2026-01-02", "b.md")]
    assert [r.key for r in S.read_daily_index(spark, str(tmp_path / "i.json"), "users").collect()] == ["budi"]
    own = {"months": [{"p": "2026-01"}, {"p": "2026-02"}], "names": ["A", "B"], "classes": ["bank"], "companies": [{"t": "X", "n": "n", "k": [{"tp": 50, "h": [[1, 1, 0, 1, 50.0, 10]]}, None]}]}
    (tmp_path / "o.json").write_text(json.dumps(own))
    assert [(r.entity, str(r.period), r.party, r["class"], r.local, r.shares) for r in S.read_positions(spark, str(tmp_path / "o.json")).collect()] == [("X", "2026-01-01", "B", "bank", True, 10)]


def test_backrefs(spark):
    rows = [("E", 0, None, ["a"]), ("E", 1, 0, None), ("E", 2, None, ["b"])]
    full = S.resolve_backrefs(spark.createDataFrame(rows, "entity string, idx int, ref int, holders array<string>"))
    assert {r.idx: r.holders for r in full.collect()} == {0: ["a"], 1: ["a"], 2: ["b"]}
    assert {r.idx: r.ref for r in S.compress_repeats(full).collect()} == {0: None, 1: 0, 2: None}


def test_prices_and_delimiters(spark, tmp_path):
    (tmp_path / "BBCA.csv").write_text("date,Close 1D\n2026-01-02,100\n2026-01-01,\n2026-01-03,0\nx,5\n")
    assert [(r.code, str(r.date), r.close) for r in S.read_prices(spark, str(tmp_path / "*.csv")).collect()] == [("BBCA", "2026-01-02", 100.0)]
    t = spark.createDataFrame([("a;b;c\n1,2",), ("a\tb",), ("one",)], "text string")
    assert [r.delimiter for r in S.detect_delimiter(t, "text").collect()] == [";", "\t", ","]
    df = spark.createDataFrame([("1,5", "x"), ("2", "3"), ("", "y")], "a string, b string")
    assert {r.column: r.numeric for r in S.infer_numeric(df).collect()} == {"a": True, "b": False}


def test_log_versions_pieces(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in S.read_jsonl(spark, str(tmp_path / "l.jsonl"), "id int").collect() if r.id) == [1, 2]
    df = spark.range(10)
    v, new = S.write_versioned(df, str(tmp_path / "t"))
    assert new and S.write_versioned(df.orderBy(F.desc("id")), str(tmp_path / "t")) == (v, False)
    text = "aé" * 50 + "漢字"
    t = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id bigint, text string")
    got = S.split_bytes(t, "doc_id", "text", 7).orderBy("piece").collect()
    assert "".join(r.content for r in got) == text and max(len(r.content.encode()) for r in got) <= 7


@pytest.fixture(scope="module")
def stream(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stream")
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.parquet(str(folder / "in"))
    return e, lambda: spark.readStream.schema(e.schema).parquet(str(folder / "in"))


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams(spark, stream, tmp_path):
    e, s = stream
    for name, f in {"rate": lambda x: W.rate_flags(x, "user_id", "ts", 0, 0), "quota": lambda x: W.quota_counts(x, "user_id", "ts"), "sess": lambda x: W.sessions(x, "user_id", "ts")}.items():
        batch = {tuple(r) for r in f(e).collect()}
        got = [tuple(r) for r in run(spark, f(s()), name).collect()]
        assert got and set(got) <= batch and len(set(got)) == len(got)
    first = run(spark, W.dedupe_stream(s(), ["user_id"], "ts", "365 days"), "dedupe")
    assert first.count() == e.select("user_id").distinct().count()
    matched = run(spark, W.match_streams(s().where("event_type = 'error'").select("user_id", F.col("ts").alias("t1")), s().where("event_type = 'purchase'").select(F.col("user_id"), F.col("ts").alias("t2")), "user_id", "t1", "t2", 2), "matched")
    a, b = e.where("event_type = 'error'"), e.where("event_type = 'purchase'")
    want = a.alias("a").join(b.alias("b"), (F.col("a.user_id") == F.col("b.user_id")) & (F.abs(F.unix_micros("a.ts") - F.unix_micros("b.ts")) <= 2 * 86_400_000_000)).count()
    assert matched.count() == want
    assert W.retain(e, "ts", 10, F.lit("2024-01-31").cast("timestamp")).count() < e.count()
