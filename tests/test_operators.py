"""Operators on small fixtures: nulls, ties, repeats, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from filingflow.operators import audit as V
from filingflow.operators import budget as B
from filingflow.operators import catalog as D
from filingflow.operators import claims as C
from filingflow.operators import quality as Q
from filingflow.operators import records as R
from filingflow.operators import relational as rel
from filingflow.operators import search as X
from filingflow.operators import signals as K
from filingflow.operators import structure as A
from filingflow.operators import usage as U


def d(s):
    return dt.date.fromisoformat(s)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


MD = """# Ringkasan

Paragraf pembuka yang cukup panjang untuk menjadi deskripsi dokumen ini.

## BBCA — Bank

- [R] akan rights issue — @Budi 09:15 +2 5 balasan (F1)
- [R] Akan rights issue! — @ani 10.20 (F2)

| 2026-09-22 | RUPS |

```
# bukan judul
```

## Lintas emiten

- [K] BBCA, TLKM: kontrak baru — @sari 11:00 dari 4 akun (F3)
"""


@pytest.fixture(scope="module")
def md(spark):
    return spark.createDataFrame([(1, MD, d("2026-09-22")), (2, None, None), (3, "", None), (4, "tanpa baris", None)], "doc_id bigint, text string, date date")


def test_records_are_lossless(md):
    r = R.partition_records(md, "doc_id", "text", ["BBCA"])
    checked = {x.doc_id: (x.records, x.lossless) for x in R.check_lossless(md, r, "doc_id", "text").collect()}
    assert all(ok for _, ok in checked.values()) and checked[1][0] > 5
    first = r.where("doc_id = 1").orderBy("ordinal").collect()
    assert [x.kind for x in first][:2] == ["heading", "text"] and first[0].offset == 0
    assert {x.code for x in first if x.context and x.context.startswith("BBCA")} == {"BBCA"}
    a = R.annotate_records(r, "doc_id").where("event_date is not null").collect()
    assert [str(x.event_date) for x in a] == ["2026-09-22"]
    info = {x.doc_id: x for x in R.md_info(md, "doc_id", "text").collect()}
    assert info[1].title == "Ringkasan" and info[1].headings == 2 and info[1].description.startswith("Paragraf")


def test_claims(md):
    c = C.parse_claims(md, "doc_id", "text", "date")
    got = {(x.code, x.fid): x for x in c.collect()}
    assert set(got) == {("BBCA", "F1"), ("BBCA", "F2"), ("BBCA", "F3"), ("TLKM", "F3")}
    assert got["BBCA", "F1"].accounts == 3 and got["BBCA", "F1"].replies == 5 and got["TLKM", "F3"].accounts == 4 and got["TLKM", "F3"].text == "kontrak baru"
    folded = {x.fid: x.dups for x in C.fold_claims(c).where("code = 'BBCA'").collect()}
    assert folded == {"F1": ["F2"], "F3": []}
    assert {x.types[0] for x in C.classify_actions(c, "text").collect() if x.types} == {"rights_issue"}
    assert C.parse_claims(md.limit(0), "doc_id", "text", "date").count() == 0


def test_date_ranges(spark):
    t = spark.createDataFrame([(1, "Periode 22–24 September 2026 dan 1 Agustus - 5 September 2026"), (2, "30 - 31 Februari 2026"), (3, None)], "id bigint, text string")
    got = [(r.id, str(r.start), str(r.end)) for r in D.text_date_ranges(t, "id", "text").orderBy("id", "place").collect()]
    assert got == [(1, "2026-08-01", "2026-09-05"), (1, "2026-09-22", "2026-09-24")]
    docs = spark.createDataFrame([(1, d("2026-09-01"), d("2026-09-30"), "month"), (2, d("2026-09-24"), d("2026-09-24"), "day")], "id bigint, start date, end date, precision string")
    ranges = D.text_date_ranges(t, "id", "text")
    assert [str(r.start) for r in D.refine_dates(docs, ranges, "id").orderBy("id").collect()] == ["2026-09-22", "2026-09-24"]


def test_relational(spark):
    left = spark.createDataFrame([("a", d("2026-01-10"), 1), ("a", d("2026-01-20"), 2), ("b", d("2026-01-01"), 3)], "k string, day date, id int")
    right = spark.createDataFrame([("a", d("2026-01-05"), 10.0), ("a", d("2026-01-05"), 12.0), ("a", d("2026-01-11"), None)], "k string, at date, close double")
    got = {r.id: r.close for r in rel.asof_join(left, right.where("close is not null"), ["k"], "day", "at", "close", 7).collect()}
    assert got == {1: 12.0, 2: None, 3: None}
    docs = spark.createDataFrame([(1, d("2026-01-01"), d("2026-01-02")), (2, d("2026-01-02"), d("2026-01-03")), (3, None, None)], "doc_id bigint, start date, end date")
    covering = spark.createDataFrame([(d("2026-01-01"),), (d("2026-01-02"),)], "day date")
    assert {r.doc_id for r in rel.drop_fully_covered(docs, covering, "doc_id", "start", "end", "day").collect()} == {2, 3}
    v = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", None)], "g string, v double")
    assert rows(rel.rank_pct(v, "v", ["g"], "p").select("v", "p")) == rows(spark.createDataFrame([(1.0, 17), (2.0, 67), (2.0, 67), (None, None)], "v double, p bigint"))
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7)], "a int, b int")
    assert rows(rel.components(edges)) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 7)]
    s = spark.createDataFrame([("x", 1), ("x", None), ("y", 2)], "k string, v int").groupBy("k").agg(rel.sum_strict("v").alias("s"))
    assert rows(s) == [("x", None), ("y", 2)]


POSITIONS = "entity string, party string, period date, shares bigint, pct double"


def test_signals(spark):
    months = [d(f"2026-0{m}-01") for m in range(1, 5)]
    p = []
    for k, m in enumerate(months):
        p += [("E", "anchor", m, 4800, 4.8), ("E", "seller" if k < 2 else "buyer", m, 12_345, 12.345)]
        if k == 3:
            p.append(("E", "late", m, 3000, 3.0))
        p.append(("F", "seller" if k < 2 else "buyer", m, 777, 60.0))
    positions = spark.createDataFrame(p, POSITIONS)
    axis = spark.createDataFrame([(m,) for m in months], "period date")
    usable = K.usable_periods(positions, axis)
    assert usable.where("usable").count() == 8
    c = K.changes(positions, usable)
    t = K.block_transfers(c).where("entity = 'E'").collect()
    assert [(r.seller, r.buyer, r.tier) for r in t] == [("seller", "buyer", "strong")]
    index, pooled = K.party_index(positions), spark.createDataFrame([("custodian",)], "party string")
    assert {r.party for r in K.new_parties(index, usable, pooled).where("entity = 'E'").collect()} == {"buyer", "late"}
    assert {r.party for r in K.exited_parties(index, usable, pooled).where("entity = 'E'").collect()} == {"seller"}
    assert {r.party for r in K.near_threshold(positions, usable, pooled).collect()} == {"anchor"}
    everyone = spark.createDataFrame([("buyer",), ("seller",), ("anchor",)], "party string")
    assert {r.party for r in K.new_parties(index, usable, everyone).where("entity = 'E'").collect()} == {"late"}
    assert K.exited_parties(index, usable, everyone).count() == K.near_threshold(positions, usable, everyone).count() == 0
    # An arrival after an unusable period, an exit before one, and an unusable end say nothing.
    bad = lambda m: usable.withColumn("usable", F.col("usable") & (F.col("period") != F.lit(m)))
    assert {r.party for r in K.new_parties(index, bad(months[1]), pooled).where("entity = 'E'").collect()} == {"late"}
    assert K.exited_parties(index, bad(months[2]), pooled).where("entity = 'E'").count() == 0
    assert K.new_parties(index, bad(months[3]), pooled).count() == K.near_threshold(positions, bad(months[3]), pooled).count() == 0
    listed = K.entity_parties(positions, usable, spark.createDataFrame([("buyer", "LISTED CORE")], "party string, key string"), spark.createDataFrame([("F", "LISTED CORE")], "entity string, key string"))
    assert [(r.entity, r.party, r.is_entity, r.pct) for r in listed.collect()] == [("E", "buyer", "F", 12.345)]
    none = spark.createDataFrame([], "party string")
    assert [(r.old, r.new, r.entities, r.tier) for r in K.renames(c, none).collect()] == [("seller", "buyer", 2, "medium")]
    keys = spark.createDataFrame([("seller", "k"), ("buyer", "k"), ("anchor", "a"), ("late", "l")], "party string, key string")
    assert {r.merged for r in K.merge_variants(positions, keys, axis).where("party = 'buyer'").collect()} == {"seller"}


def test_structure(spark):
    p = spark.createDataFrame([("E", "a", d("2026-01-01"), 60, 60.0), ("E", "b", d("2026-01-01"), 2, 2.0), ("E", "c", d("2026-01-01"), 3, 3.0)], POSITIONS)
    r = A.structure(p, spark.createDataFrame([("c",)], "party string")).first()
    assert (r.n, r.total, r.rest, r.hhi, r.top, r.shadow, r.avg_rest) == (3, 65.0, 35.0, 3613.0, 60.0, 2.0, 2.5)
    bad = spark.createDataFrame([("E", "a", d("2026-01-01"), None, 101.0), ("E", "a", d("2026-01-01"), 1, 1.0)], POSITIONS)
    assert A.snapshot_issues(bad).first().issues == "duplicate,range,shares,total"


def test_search(spark):
    t = spark.createDataFrame([(1, "Rights issue of BBCA"), (2, "rights of others; tidak ada rights issue"), (3, "arights issue"), (4, None)], "doc_id bigint, text string")
    p = X.build_postings(t, "doc_id", "text")
    assert {r.doc_id for r in X.search(t, p, "doc_id", "text", ["rights issue"]).collect()} == {1, 2}
    assert {r.doc_id for r in X.search(t, p, "doc_id", "text", [], ["BBCA"]).collect()} == {1}
    assert rows(X.negated_only(t.withColumnRenamed("text", "content"), "doc_id", r"(?i)\brights issue")) == [(2, 1)]
    v = spark.createDataFrame([("dividend", 5), ("dividen", 9), ("divided", 7)], "word string, docs int")
    q = spark.createDataFrame([("dividem",), ("zzz",)], "term string")
    assert [(r.term, r.word) for r in X.nearest_terms(q, v).collect()] == [("dividem", "dividen")]
    phrases = spark.createDataFrame([("rights",), ("rights issue",)], "phrase string")
    assert rows(X.longest_known_phrase(t, "doc_id", "text", phrases)) == [(1, "rights issue"), (2, "rights issue")]


def test_audit(spark):
    a = spark.createDataFrame([(1, "see [1], [2-4; 7] and [9–90] total 1.250 units, about 98 or 5,5 juta"), (2, None)], "id bigint, text string")
    assert [r.source for r in V.citations(a, "id", "text").orderBy("source").collect()] == [1, 2, 3, 4, 7, 9, 90]
    s = spark.createDataFrame([(1, "1250 and 100 and 5500000")], "id bigint, text string")
    left = V.unsupported_numbers(V.extract_numbers(a, "id", "text"), V.extract_numbers(s, "id", "text"), "id")
    assert {r.written for r in left.collect()}.isdisjoint({"1.250", "98", "5,5"})
    names = spark.createDataFrame([("BBCA", "PT Bank Central Asia Tbk")], "code string, official string")
    pairs = spark.createDataFrame([("BBCA", "Bank Central Asia"), ("BBCA", "Bank Mandiri")], "code string, name string")
    assert [r.name for r in V.wrong_names(pairs, names).collect()] == ["Bank Mandiri"]


def test_budgets(spark):
    t = spark.createDataFrame([("q", i, f"2026-01-0{i % 2 + 1}", s) for i, s in enumerate([50, 70, 30, 20, 90])], "k string, i int, day string, size int")
    assert [r.i for r in B.prefix_budget(t, "k", [F.asc("i")], "size", 120).orderBy("i").collect()] == [0, 1]
    assert [r.i for r in B.greedy_budget(t, "k", ["i"], "size", 100).orderBy("i").collect()] == [0, 2, 3]
    assert [r.i for r in B.round_robin_budget(t, "k", "day", ["i"], "size", 150).orderBy("i").collect()] == [0, 1, 3]
    assert [r.batch for r in B.pack_batches(t, "k", ["i"], "size", 100).orderBy("i").collect()] == [0, 1, 1, 2, 3]


def test_quality(spark):
    days = spark.createDataFrame([(d("2026-01-05"), "final", True), (d("2026-01-06"), "provisional", True), (d("2026-01-07"), "final", False), (d("2026-01-08"), "final", True), (d("2026-01-08"), "final", True)], "day date, state string, ok boolean")
    empty = days.limit(0).select("day")
    assert [str(r.day) for r in Q.eligible_days(days, empty, empty, "2026-01-01").collect()] == ["2026-01-05"]
    with pytest.raises(ValueError):
        Q.assert_not_shrinking(empty, empty, empty, days)
    assert Q.assert_not_shrinking(days, empty, empty, days) == 4
    w = spark.createDataFrame([("a", "2026-01-01 08:00", "2026-01-01 09:00"), ("a", "x", "y"), ("b", "2026-01-01 10:00", "2026-01-01 09:00")], "name string, start string, end string")
    assert sorted(r.issues for r in Q.check_windows(w).collect()) == ["order", "time,twice", "twice"]
    f = spark.createDataFrame([("n", "c", " ", "z")], "name string, cat string, body string, sha string")
    e = spark.createDataFrame([("n", "d", "z2")], "name string, cat string, sha string")
    assert Q.check_files(f, e, "999").first().issues == "category,hash,empty"


def test_usage_is_empty_safe(spark):
    q = spark.createDataFrame([], "id bigint, stamp bigint, user_key string, question string, normalized string, status string, terms string, mode string")
    u = spark.createDataFrame([], "id bigint, stamp bigint, result string, metrics string")
    assert U.usage_totals(u, 0).first().n == 0 and U.usage_by_mode(q, u, 0).count() == 0 and U.top_terms(q).count() == 0


def test_vocabulary_counts_documents(spark):
    t = spark.createDataFrame([(1, "Rights rights issue 1234567"), (2, "issue"), (3, None), (4, "")], "doc_id bigint, text string")
    assert sorted(rows(X.vocabulary(t, "text"))) == [("issue", 2), ("rights", 1)]
    postings = X.build_postings(t, "doc_id", "text").groupBy("term").agg(F.count("*"))
    assert sorted(rows(postings)) == sorted(rows(X.vocabulary(t, "text")))
    assert rows(X.vocabulary(t.limit(0), "text")) == []


def test_nearest_terms_over_the_whole_vocabulary(spark, tmp_path):
    """The nearest word stands in one document only; the keys by which words meet lose no pair against brute force."""
    import random
    import re

    from filingflow.plans import documents

    spark.createDataFrame([(1, "dividend")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "a dividende")] + [(k, "divider dividing") for k in range(2, 30)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(documents.QUERIES["X09_nearest_terms"](spark, str(tmp_path))) == [("dividend", "dividende", 1)]

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line, before = [i], line
            for j, y in enumerate(b, 1):
                line.append(min(before[j] + 1, line[-1] + 1, before[j - 1] + (x != y)))
        return line[-1]

    rng = random.Random(5)
    words = sorted({"a" + "".join(rng.choice("abcdeéß") for _ in range(rng.randint(0, 9))) for _ in range(400)})
    terms, docs = words[::7] + ["abcdefghijkl", "aa", ""], {w: rng.randint(1, 4) for w in [*words, "abdefgijkl", "abcdefghijklmno", "b"]}
    in_order = lambda a, b: re.search(".*".join(b), a) is not None
    want = {}
    for t in terms:
        near = [(e, -n, w) for w, n in docs.items() if w[:1] == t[:1] for e in [edits(t, w)] if 0 < e * 10 <= 3 * len(t) and (e <= 1 or in_order(t, w) or in_order(w, t))]
        if near:
            want[t] = (min(near)[2], min(near)[0])
    got = X.nearest_terms(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(list(docs.items()), "word string, docs int")).collect()
    assert {r.term: (r.word, r.edits) for r in got} == want and want["abcdefghijkl"] == ("abdefgijkl", 2)
