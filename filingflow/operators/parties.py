"""Stable ids of parties over the periods of an entity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of a name that tell no party apart, and marks of accounts, whose names keep their order and numbers.
NAME_NOISE = ["PT", "TBK", "PERSERO", "PERSEROAN", "PERUSAHAAN", "LTD", "LIMITED", "PTE", "PRIVATE", "INC", "CO", "CORP", "CORPORATION", "DRS", "DRA", "IR", "SE", "SH", "SKH", "DR"]
ACCOUNT = r"\b(?:A\s*[/.-]\s*C|AC|ACCT|ACCOUNT|REKENING|QQ|Q[. ]*Q|NOMINEE[S]?)\b"


def signature(name: Column | str) -> Column:
    """What spellings of one party share: its words in order of the alphabet, for an account in their own order. A name without a word
    of its own is its own signature, and no other name's."""
    raw = F.upper(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    words = F.filter(F.split(raw, "[^A-Z0-9]+"), lambda w: (w != "") & ~w.isin(NAME_NOISE))
    plain = F.concat(F.lit("name "), F.array_join(F.array_sort(words), " "))
    account = F.concat(F.lit("account "), F.array_join(words, " "))
    return F.when(F.size(words) == 0, F.concat(F.lit("raw "), F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))).when(raw.rlike(ACCOUNT), account).otherwise(plain)


class Spellings:
    """The spellings of one signature in one entity so far: the number of the party that each last stood for, and whether that was in
    doubt. Ids of different signatures never meet, so this is all that an id depends on."""

    def __init__(self, known: dict[str, tuple[int, bool]] | None = None, parties: int = 0):
        self.known, self.parties = known or {}, parties

    def take(self, names: list[str]) -> dict[str, tuple[int, bool, bool]]:
        """Party, doubt and novelty of each spelling of a period. A spelling keeps its party unless another one of the period has the
        same; a new spelling that stands alone takes the only party there is. All else is a new party. Two spellings in a period, or any
        doubt before, put in doubt what comes."""
        held = [self.known[n][0] for n in names if n in self.known]
        doubt = len(names) > 1 or any(d for _, d in self.known.values())
        there = {p for p, _ in self.known.values()}
        out = {}
        for n in sorted(names):
            if n in self.known and held.count(self.known[n][0]) == 1:
                out[n] = self.known[n][0], doubt, False
            elif n not in self.known and not doubt and len(there) == 1:
                out[n] = next(iter(there)), False, False
            else:
                out[n] = self.parties, doubt or len(there) > 1, True
                self.parties += 1
        self.known |= {n: (p, d) for n, (p, d, _) in out.items()}
        return out


def numbered_spellings(history: DataFrame) -> DataFrame:
    """history (entity, period, name): rows (entity, period, name, signature, party, ambiguous, new), party counted from 0 in each
    signature. A partition holds whole signatures in order of period and passes through one period at a time, so an entity of any size
    is spread over the cluster. Repeated names of a period count once; rows without entity or period are left out."""
    rows = history.where("entity IS NOT NULL AND period IS NOT NULL").select("entity", "period", F.coalesce("name", F.lit("")).alias("name")).distinct().withColumn("signature", signature("name"))
    rows = rows.repartition("entity", "signature").sortWithinPartitions("entity", "signature", "period", "name")
    schema = rows.withColumns({"party": F.lit(0).cast("bigint"), "ambiguous": F.lit(False), "new": F.lit(False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, period, names, state = None, None, [], Spellings()

        def closed() -> list[tuple]:
            found = state.take(names) if names else {}
            return [(owner[0], period, n, owner[1], *found[n]) for n in names]

        for batch in batches:
            out = []
            for entity, day, name, sign in zip(*(c.to_pylist() for c in batch.columns)):
                if (entity, sign) != owner or day != period:
                    out += closed()
                    names = []
                    if (entity, sign) != owner:
                        state = Spellings()
                    owner, period = (entity, sign), day
                names.append(name)
            yield from _rows(out, batch.schema)
        yield from _rows(closed() if names else [], batch.schema if owner else None)

    return rows.mapInArrow(run, schema)


def _rows(out: list[tuple], like: pa.Schema | None) -> Iterator[pa.RecordBatch]:
    if out:
        kinds = [*like.types, pa.int64(), pa.bool_(), pa.bool_()]
        names = [*like.names, "party", "ambiguous", "new"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def assign_party_ids(history: DataFrame) -> DataFrame:
    """history (entity, period, name): rows (entity, period, name, party_id, ambiguous). Ids count from 0 in each entity, by period and
    name of their first row. An exact spelling keeps its id; another spelling of the same signature takes it over where it stands alone
    and the signature has had one party only; what is in doubt stays apart, and so does what comes after it. Equal amounts say nothing."""
    rows = numbered_spellings(history)
    ids = rows.where("new").withColumn("party_id", (F.row_number().over(Window.partitionBy("entity").orderBy("period", "name")) - 1).cast("bigint"))
    return rows.join(ids.select("entity", "signature", "party", "party_id"), ["entity", "signature", "party"]).select("entity", "period", "name", "party_id", "ambiguous")
