"""A long list is cut in time that grows with its items, not with their square."""

import time

from filingflow.operators import sections as S


def test_long_list(spark):
    codes = spark.createDataFrame([("ABCD",)], "code string")

    def run(n):
        d = spark.createDataFrame([("a", "md", "".join(f"- item number {k}\n" for k in range(n)))], "doc string, kind string, text string")
        begin = time.time()
        rows = S.partition_documents(d, codes).collect()
        return [r.content for r in sorted(rows, key=lambda r: r.ordinal)], time.time() - begin

    run(100)
    got, took = run(12_000)
    assert got == [f"- item number {k}\n" for k in range(12_000)] and took < 10
