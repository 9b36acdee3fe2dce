"""Many claims and disclosures of one code and day meet once, not each with each."""

import datetime as dt
import time

from pyspark.sql import functions as F

from filingflow.operators import verdicts as V


def test_many_claims_of_one_day(spark):
    day = F.lit(dt.date(2024, 1, 5))

    def run(n):
        claims = spark.range(n).select(F.col("id").cast("string").alias("fid"), F.lit("AAAA").alias("code"), day.alias("date"), F.lit(V.BIT["buyback"] if "buyback" in V.BIT else 1).cast("bigint").alias("topics"))
        told = spark.range(n).select(F.lit("AAAA").alias("code"), day.alias("date"), F.lit("baru").alias("status"), F.array(F.lit("hukum")).alias("categories"), F.lit("x").alias("text"), F.format_string("D%06d", "id").alias("ref"))
        begin = time.time()
        rows = V.disclosure_support(claims, told).collect()
        return rows, time.time() - begin

    run(10)
    rows, took = run(10_000)
    assert len(rows) == 10_000 and {(r.support, r.other.ref) for r in rows} == {(None, "D000000")} and took < 10
