"""Ids of parties over a stream of periods."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from filingflow.operators.parties import Spellings, signature

PARTIES = "entity string, period date, name string, signature string, party long, ambiguous boolean"


class _Parties(StatefulProcessor):
    """State of one signature in one entity: a map of its spellings and the number of parties so far; both expire after a time to live
    without new rows."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}
        self.spellings = handle.getMapState("spellings", "name string", "party long, doubt boolean", **ttl)
        self.count = handle.getValueState("parties", "n long", **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {n[0]: (int(v[0]), bool(v[1])) for n, v in self.spellings.iterator()} if self.spellings.exists() else {}
        state = Spellings(known, int(self.count.get()[0]) if self.count.exists() else 0)
        frame, out = pd.concat(list(rows)), []
        for period, part in frame.groupby("period", sort=True):
            out += [(key[0], period, n, key[1], p, d) for n, (p, d, _) in state.take(sorted(set(part["name"]))).items()]
        for n, v in state.known.items():
            self.spellings.updateValue((n,), v)
        self.count.update((state.parties,))
        yield pd.DataFrame(out, columns=["entity", "period", "name", "signature", "party", "ambiguous"])

    def close(self) -> None:
        pass


def party_ids_stream(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """stream (entity, period, name): the parties that numbered_spellings gives, as periods arrive; (entity, signature, party) names a
    party for good. Periods of one batch are taken in order; what arrives of an earlier period later is a step of its own, and a spelling
    keeps the party that it has. With ttl_ms, spellings of a signature that has no new rows for so long are forgotten: what comes then is
    counted from 0 again. Rows without entity or period are left out."""
    rows = stream.where("entity IS NOT NULL AND period IS NOT NULL").select(F.col("entity").cast("string").alias("entity"), F.col("period").cast("date").alias("period"), F.coalesce("name", F.lit("")).alias("name"))
    return rows.withColumn("signature", signature("name")).groupBy("entity", "signature").transformWithStateInPandas(_Parties(ttl_ms), PARTIES, "append", "none")
