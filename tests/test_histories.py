"""Back references, chains of spellings, variants and natural order against plain Python on random rows."""

import datetime as dt
import random

from filingflow.operators import reports as P
from filingflow.operators import signals as K
from filingflow.operators import structure as A
from filingflow.sources import files as S


def test_back_references_over_random_histories(spark):
    rng = random.Random(1)
    rows = [(f"E{e}", i, rng.choice([None, ["a"], ["a", "b"], ["c"], []])) for e in range(30) for i in range(20)]
    df = spark.createDataFrame(rows, "entity string, idx int, holders array<string>").repartition(4)
    packed = S.compress_repeats(df)
    got = {(r.entity, r.idx): (r.ref, r.holders) for r in packed.collect()}
    for e in {r[0] for r in rows}:
        stored = None
        for _, i, holders in sorted(r for r in rows if r[0] == e):
            if holders is None:
                assert got[e, i] == (None, None)
            elif stored and stored[1] == holders:
                assert got[e, i] == (stored[0], None)
            else:
                assert got[e, i] == (None, holders)
                stored = (i, holders)
    assert sorted(map(tuple, S.resolve_backrefs(packed).collect()), key=str) == sorted(rows, key=str)
    assert S.compress_repeats(df.limit(0)).count() == 0


def test_chains_of_spellings_in_any_order(spark):
    rng = random.Random(2)
    month = lambda k: dt.date(2020 + k // 12, k % 12 + 1, 1)
    rows, want = [], {}
    for e in range(12):
        at, chain, names = 0, None, rng.sample([f"S{k:02}" for k in range(30)], 12)
        for name in names:
            gap = rng.random() < 0.3
            at += gap
            far = rng.random() < 0.2
            chain = name if chain is None or gap or far else chain
            pct = 5.0 + (7 * len(want) % 90 if far or gap or chain == name else rows[-1][4] - 5.0)
            n = rng.randint(1, 4)
            rows += [(f"E{e}", name, month(at + k), 1000 * (len(want) + 1) ** 2, pct) for k in range(n)]
            at += n
            want[f"E{e}", name] = chain
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "entity string, party string, period date, shares bigint, pct double")
    axis = spark.createDataFrame([(month(k),) for k in range(70)], "period date")
    keys = spark.createDataFrame([(f"S{k:02}", "same") for k in range(30)], "party string, key string")
    assert {(r.entity, r.party): r.merged for r in K.merge_variants(df, keys, axis).collect()} == want and len(set(want.values())) < len(want)


def test_variants_fit_each_other_alone(spark):
    s = "name string, shares bigint"
    a = spark.createDataFrame([("PT Alpha Beta", 10), ("Gamma Delta", 20), ("Sinarmas X", 30), ("Epsilon", 40), ("Zeta", None), ("Eta One", 50), ("Abc", 60), ("Theta", 70)], s)
    b = spark.createDataFrame([("Beta Alpha Tbk", 11), ("Gamm Foo", 20), ("Sinar Y", 30), ("EPSILON", 41), ("Epsilon Ltd", 40), ("ZETA", None), ("Eta Two", 50), ("Eta Three", 50), ("Abcd", 60), ("Iota", 70)], s)
    got = {tuple(r) for r in P.match_variants(a, b).collect()}
    assert got == {("PT Alpha Beta", "Beta Alpha Tbk"), ("Gamma Delta", "Gamm Foo"), ("Sinarmas X", "Sinar Y"), ("Zeta", "ZETA")}
    assert P.match_variants(a.limit(0), b).count() == 0


def test_natural_order(spark):
    cells = ["item 10", "Item 9", "item 009", "Ítem 2", "", None, "12,5", "1.234,5", "-3", "zeta", "7 a", "7 B", " ", "12345678901234567890123 x", "9 x"]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, cell string")
    up = [cells[r.id] for r in A.sort_smart(df, "cell", "id").collect()]
    assert up == ["-3", "12,5", "1.234,5", "7 a", "7 B", "9 x", "12345678901234567890123 x", "Ítem 2", "Item 9", "item 009", "item 10", "zeta", "", None, " "]
    down = [cells[r.id] for r in A.sort_smart(df, "cell", "id", True).collect()]
    assert down == ["zeta", "item 10", "Item 9", "item 009", "Ítem 2", "12345678901234567890123 x", "9 x", "7 B", "7 a", "1.234,5", "12,5", "-3", "", None, " "]
