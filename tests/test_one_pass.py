"""Work that is done once: plans of many requests, types of texts, joins of holdings, phrases of texts."""

import pytest
from pyspark.sql import functions as F

from filingflow.operators import digest as D


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_requests_stream_and_batches_may_cut_them(spark, small_batches):
    docs = spark.range(8).select(F.col("id").cast("string").alias("doc"), F.concat(F.lit("# D\n\n## Sorotan\nhot\n## QAAA — A\n"), F.repeat(F.lit("- line of the day\n"), F.col("id").cast("int") * 9), F.lit("## QAAB — B\n- b\n## Lampiran: x\n- a\n")).alias("text"))
    codes = spark.createDataFrame([("QAAA",), ("QAAB",)], "code string")
    asked = spark.range(6).select(F.nullif("id", F.lit(5)).alias("request")).crossJoin(docs.select("doc"))
    s = D.sized(D.daily_segments(docs, codes)).join(asked, "doc").withColumn("day", F.col("doc").cast("int")).withColumn("cat", F.lit("bei")).withColumn("head_only", F.lit(False))
    plan = D.digest_plan(s.coalesce(1), 900)
    assert "FlatMapGroupsIn" not in plan_of(plan)
    rows = [tuple(r) for r in plan.collect()]
    assert len(rows) == len(set(rows)) == 6 * 8 * 5
    each = {q: sorted(r[1:] for r in rows if r[0] == q) for q in (None, 0, 1, 2, 3, 4)}
    assert all(x == each[0] for x in each.values())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r[1:] for r in map(tuple, D.digest_plan(s.where("request = 0"), 900).collect())) == each[0]
    assert {r[2] for r in each[0]} != {0} and sum(r[2] for r in each[0]) <= 900 + D.LEAD


def test_types_of_bullets_are_found_once(spark):
    from filingflow.operators import claims as C

    docs = spark.createDataFrame([(1, "## QAAA — PT A Tbk\n- buyback and merger\n- QAAA\n"), (2, None)], "doc_id int, text string")
    bullets = C.digest_events(docs, "doc_id", "text", "Tbk$")
    assert plan_of(bullets).count("bonus_shares]") == 1
    assert sorted((x.code, x.text, x.type) for x in bullets.collect()) == [("QAAA", "buyback and merger", "buyback"), ("QAAA", "buyback and merger", "merger")]


def test_types_are_found_once(spark):
    from filingflow.operators import claims as C

    r = spark.createDataFrame([(1, 1, "QAAA", "buyback with QAAB and QZZZ. tidak ada merger"), (1, 2, "QAAA", "merger of QZZZ"), (1, 3, None, "merger"), (2, 1, "QAAB", "merger akuisisi Tbk (QAAA)"), (2, 2, "QAAB", None)], "doc_id int, ordinal int, code string, content string")
    found = C.text_events(r, "doc_id", spark.createDataFrame([("QAAA",), ("QAAB",), ("QAAB",)], "code string"))
    assert plan_of(found).count("bonus_shares]") == 1
    assert sorted((x.doc_id, x.ordinal, x.code, x.type) for x in found.collect()) == [(1, 1, "QAAB", "buyback"), (1, 2, "QAAA", "merger"), (2, 1, "QAAB", "acquisition"), (2, 1, "QAAB", "merger")]


def test_each_place_of_a_text_gives_one_run(spark):
    import random
    import re

    from filingflow.operators import search as X

    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "c", "dé", "7"])
    texts = {k: " ".join(word() + rng.choice(["", ",", "\n"]) for _ in range(rng.randrange(0, 14))) for k in range(60)} | {99: None}
    phrases = {" ".join(word() for _ in range(rng.randrange(1, 8))) for _ in range(60)} - {"a"}
    t, p = spark.createDataFrame(list(texts.items()), "id int, text string"), spark.createDataFrame([(x,) for x in sorted(phrases)] + [(None,), ("",), ("a  b",)], "phrase string")
    for most in (1, 2, 5):
        found = X.longest_known_phrase(t, "id", "text", p, most)
        assert plan_of(found).count("slice(") <= 1
        want = {}
        for k, text in texts.items():
            w = re.findall(r"\w+", (text or "").lower())
            hits = [(n, " ".join(w[i : i + n])) for n in range(1, most + 1) for i in range(len(w) - n + 1) if " ".join(w[i : i + n]) in phrases]
            if hits:
                want[k] = max(hits)[1]
        assert {r.id: r.phrase for r in found.collect()} == want


def test_orders_meet_customers_before_lines_meet_parts(spark, sf):
    from filingflow.plans.tables import positions

    plan = plan_of(positions(spark, sf))
    assert -1 < plan.index("FileScan parquet [c_custkey") < plan.index("FileScan parquet [p_partkey")
