"""Ids of parties: the rule's cases, random histories against one entity's state kept as a whole, and the stream against the batch."""

import datetime as dt
import random
import re
from collections import Counter

from filingflow.operators import parties
from filingflow.streaming.parties import party_ids_stream

HISTORY = "entity string, period date, name string, total bigint, party bigint"


def frame(spark, periods, entity="E"):
    rows = [(entity, dt.date(2026, k + 1, 1), n, 100, 7) for k, names in enumerate(periods) for n in names]
    return spark.createDataFrame(rows, HISTORY)


def ids(spark, periods):
    return {(r.period.month, r.name): (r.party_id, r.ambiguous) for r in parties.assign_party_ids(frame(spark, periods)).collect()}


def test_spellings(spark):
    got = ids(spark, [["LO KHENG HONG. DRS", "ALPHA"], ["DRS LO KHENG HONG", "PT ALPHA INVESTAMA"], ["Lo Kheng Hong", "ALPHA"]])
    assert got[1, "LO KHENG HONG. DRS"] == got[2, "DRS LO KHENG HONG"] == got[3, "Lo Kheng Hong"] == (1, False)
    assert got[1, "ALPHA"] == got[3, "ALPHA"] == (0, False) and got[2, "PT ALPHA INVESTAMA"] == (2, False)
    one = lambda a, b: ids(spark, [[a], [b]])
    for a, b in [("PT TRIPLE BERKAH BERSAMA", "PT TRIPLE BERSAMA BERKAH"), ("UOB KAY HIAN PRIVATE LIMITED", "UOB KAY HIAN PTE LTD")]:
        assert len({i for i, _ in one(a, b).values()}) == 1
    for a, b in [("BANK X A/C 123", "BANK X A/C 456"), ("BANK X ACCOUNT A B", "BANK X ACCOUNT B A"), ("UOB KAY HIAN", "UOB KAY HIAN A/C CLIENT"), ("TASPEN", "TASPENNA"), ("PT", "TBK"), ("", "PT")]:
        assert len({i for i, _ in one(a, b).values()}) == 2


def test_what_is_in_doubt_stays_apart(spark):
    got = ids(spark, [["PT TASPEN", "TASPEN (PERSERO)"], ["TASPEN"]])
    assert got == {(1, "PT TASPEN"): (0, True), (1, "TASPEN (PERSERO)"): (1, True), (2, "TASPEN"): (2, True)}
    got = ids(spark, [["PT TASPEN"], ["TASPEN (PERSERO)"], [], ["PT TASPEN"], ["PT TASPEN", "TASPEN (PERSERO)"], ["PT TASPEN", "TASPEN (PERSERO)", "OTHER"], ["PT TASPEN"]])
    assert got[1, "PT TASPEN"] == got[2, "TASPEN (PERSERO)"] == got[4, "PT TASPEN"] == (0, False)
    assert got[5, "PT TASPEN"] == got[6, "PT TASPEN"] == got[7, "PT TASPEN"] == (1, True) and got[5, "TASPEN (PERSERO)"] == got[6, "TASPEN (PERSERO)"] == (2, True)
    # Equal amounts of different parties say nothing.
    assert len({i for i, _ in ids(spark, [["ALPHA"], ["BETA"]]).values()}) == 2


def sign(name):
    words = [w for w in re.split("[^A-Z0-9]+", name.upper()) if w and w not in parties.NAME_NOISE]
    return ("raw", name) if not words else ("account", *words) if re.search(parties.ACCOUNT, name.upper()) else ("name", *sorted(words))


def whole_entity(periods):
    """The rule with all of an entity's names in one table: exact spellings first, then unique signatures, else new ids in order."""
    table, out, fresh = {}, {}, 0
    for k, names in enumerate(periods):
        given, open_names = {}, []
        unsure = {n for n in names if sum(sign(m) == sign(n) for m in names) > 1 or any(flag for other, (_, flag) in table.items() if sign(other) == sign(n))}
        for n in sorted(names):
            if n in table and sum(m in table and table[m][0] == table[n][0] for m in names) == 1:
                given[n] = table[n][0]
            else:
                open_names.append(n)
        for n in open_names:
            fits = {i for other, (i, _) in table.items() if sign(other) == sign(n)} if n not in unsure and n not in table else set()
            if len(fits) == 1 and not fits & set(given.values()):
                given[n] = fits.pop()
            else:
                unsure |= {n} if fits else set()
                given[n], fresh = fresh, fresh + 1
        for n in names:
            table[n] = given[n], n in unsure
            out[k + 1, n] = table[n]
    return out


def random_periods(rng, n):
    names = ["PT Alpha", "Alpha Tbk", "Alpha", "Beta Gama", "Gama Beta", "PT GAMA BETA", "Bank X A/C 1", "Bank X A/C 2", "PT", "Delta"]
    return [rng.sample(names, rng.randint(0, 4 if rng.random() < 0.5 else 2)) for _ in range(n)]


def test_random_histories(spark):
    rng = random.Random(2)
    all_periods = {f"E{k}": random_periods(rng, 11) for k in range(60)}
    history = None
    for entity, periods in all_periods.items():
        f = frame(spark, periods, entity).toPandas()
        history = f if history is None else __import__("pandas").concat([history, f])
    df = spark.createDataFrame(history, HISTORY)
    got = {}
    for r in parties.assign_party_ids(df.unionByName(df.limit(20)).repartition(7)).collect():
        assert (r.entity, r.period.month, r.name) not in got
        got[r.entity, r.period.month, r.name] = r.party_id, r.ambiguous
    want = {(e, *key): v for e, periods in all_periods.items() for key, v in whole_entity(periods).items()}
    assert got == want
    assert parties.assign_party_ids(df.limit(0)).count() == 0


def test_stream_over_restarts_gives_what_the_batch_gives(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(3)
    history = frame(spark, random_periods(rng, 6)).unionByName(frame(spark, random_periods(rng, 6), "F"))
    (tmp_path / "in").mkdir()
    for k in (2, 4, 6):
        history.where(f"month(period) in ({k - 1}, {k})").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = spark.readStream.schema(history.schema).parquet(str(tmp_path / "in"))
        party_ids_stream(seen).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = parties.numbered_spellings(history)
    columns = ["entity", "period", "name", "signature", "party", "ambiguous"]
    assert Counter(map(tuple, streamed.select(columns).collect())) == Counter(map(tuple, batch.select(columns).collect()))
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
