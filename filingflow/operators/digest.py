"""Digests of daily files: their segments, and which of them a request reads within its budget of bytes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.operators.sections import CUT, heading_code

# Headings of head sections and appendices; bytes of a lead, of the mark of a cut, and of a listed line; shares of a budget.
HEAD = r"(?i)^(?:sorotan|yang berubah|jarang disebut)"
APPENDIX = r"(?i)^lampiran\b"
LEAD, MARK, LISTED, DEFER = 1100, 80, 160, 10
HEAD_SHARE, LIST_SHARE, LEAD_SHARE, EXHAUSTIVE_LEAD_SHARE = 0.6, 0.15, 0.55, 0.4
LEAST_ROOM, LEAST_CAP, LISTING_HEAD = 600, 6000, 120
# What a plan reads of a segment: its order, and the rest.
ORDERED = ["day", "cat", "doc", "place"]
READ = ["kind", "code", "tier", "parent", "size", "lines", "quoted", "listed", "head_only"]


def daily_segments(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows (doc, place, kind, code, tier, parent, heading, line, text) of Markdown files (doc, text): what stands before the first H2
    (pre), and each H2: an issuer's section (a known code), head, appendix or another one (aux). An H2 without code that holds H3 with
    codes is an intro, and each such H3 an issuer's section with it as parent. Tier 1 are sections without a parent, and those with one
    where a file has no others; the rest is tier 2. Joined in order, the texts are the file; null and empty files have none."""
    marked = F.regexp_replace(F.col("text"), r"(?md)^(#{2,3}[^\S\n]+\S.*)$", f"{CUT}$1")
    d = docs.where("text != ''").select("doc", F.posexplode(F.split(marked, CUT)).alias("piece", "text")).where("text != ''")
    heading = r"^(#{2,3})\s+([^\n]+?)\s*(?:\n|$)"
    level, title = F.length(F.regexp_extract("text", heading, 1)), F.regexp_extract("text", heading, 2)
    d = d.withColumn("level", level).withColumn("heading", title).withColumn("named", F.when(F.col("level") > 0, heading_code(F.col("heading"))))
    d = d.join(codes.select(F.col("code").alias("named"), F.col("code").alias("code")).distinct(), "named", "left")
    own = F.when(F.col("code").isNotNull(), "issuer").when(F.col("heading").rlike(APPENDIX), "appendix").when(F.col("heading").rlike(HEAD), "head").otherwise("aux")
    w = Window.partitionBy("doc").orderBy("piece")
    d = d.withColumn("h2", F.last(F.when(F.col("level") == 2, F.struct(own.alias("kind"), F.col("piece").alias("piece"))), ignorenulls=True).over(w))
    child = (F.col("level") == 3) & F.col("code").isNotNull() & F.coalesce(F.col("h2.kind") == "aux", F.lit(False))
    begins = (F.col("level") == 2) | child | F.lag("piece").over(w).isNull()
    before = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    d = d.withColumn("child", child).withColumn("place", F.sum(begins.cast("int")).over(w)).withColumn("line", F.coalesce(F.sum(before).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    first = lambda c: F.min_by(c, "piece")
    kind = F.when(F.col("child"), "issuer").when(F.col("level") == 2, own).otherwise("pre")
    g = d.withColumn("kind", kind).groupBy("doc", "place").agg(first("kind").alias("kind"), first("code").alias("code"), first("child").alias("child"), first("h2.piece").alias("h2"), first("heading").alias("heading"), first("line").cast("int").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("text"))
    by_h2, whole = Window.partitionBy("doc", "h2"), Window.partitionBy("doc")
    g = g.withColumn("holds", F.max(F.col("child").cast("int")).over(by_h2)).withColumn("parent", F.when(F.col("child"), F.min("place").over(by_h2)))
    g = g.withColumn("kind", F.when((F.col("kind") == "aux") & (F.col("holds") == 1), "intro").otherwise(F.col("kind")))
    g = g.withColumn("top", F.max(((F.col("kind") == "issuer") & ~F.col("child")).cast("int")).over(whole))
    tier = F.when(F.col("kind") == "issuer", F.when(~F.col("child") | (F.col("top") == 0), 1).otherwise(2))
    return g.select("doc", "place", "kind", F.when(F.col("kind") == "issuer", F.col("code")).alias("code"), tier.alias("tier"), "parent", F.nullif("heading", F.lit("")).alias("heading"), "line", "text")


def sized(segments: DataFrame, quoted: str = r"\[Mengutip keterbukaan\]") -> DataFrame:
    """What a plan needs to know of segments: their bytes, where their lines end, whether they quote a disclosure, and the bytes of the
    line that lists them. The texts stay where they are."""
    ends = F.transform(F.split("text", r"(?<=\n)"), lambda x: F.octet_length(x))
    return segments.select(*[c for c in segments.columns if c != "text"], F.octet_length("text").alias("size"), ends.alias("lines"), F.col("text").rlike(quoted).alias("quoted"), F.least(F.lit(LISTED), F.octet_length(F.concat_ws(" ", F.lit("-"), "heading")) + 1).alias("listed"))


class _Segment:
    __slots__ = ("row", "kind", "code", "tier", "parent", "size", "lines", "quoted", "listed", "preferred", "own", "taken", "late")

    def __init__(self, row: int, kind, code, tier, size, lines, quoted, listed, head_only, preferred: frozenset[str], exhaustive: bool):
        self.row, self.kind, self.code, self.size, self.lines, self.quoted, self.listed = row, kind, code, size, lines, bool(quoted), listed
        if self.kind == "appendix":
            self.kind = "aux" if exhaustive else "note"
            if not exhaustive:
                self.size, self.lines = self.listed + MARK, [self.listed + MARK]
        self.preferred = self.kind == "issuer" and self.code in preferred
        self.tier = 1 if self.preferred else tier
        self.own = not head_only or self.kind in ("pre", "head", "note", "aux")
        self.parent, self.taken, self.late = None, 0, False

    def cut(self, limit: int) -> int:
        """Bytes of the segment cut at a line's end within a limit, with the mark of the cut; its first line is always there."""
        if self.size <= limit:
            return self.size
        held = 0
        for n in self.lines:
            if held and held + n > limit - MARK:
                break
            held += min(int(n), max(100, limit - MARK))
        return held + MARK


class _Plan:
    """One request's plan: bytes taken of each segment. `left` is what a round may still spend."""

    def __init__(self, docs: list[list[_Segment]], budget: int, exhaustive: bool):
        self.docs, self.budget, self.exhaustive, self.used = docs, budget, exhaustive, 0
        self.all = [s for d in docs for s in d]

    def give(self, s: _Segment, n: int) -> None:
        if s.parent and not s.parent.taken:
            self.give(s.parent, s.parent.size)
        self.used += n - s.taken
        s.taken = n

    def rounds(self, queues: list[list[_Segment]], left: int, size) -> int:
        """Turn by turn the next segment of each day gets size(segment) while it fits; a day ends at the first one that doesn't."""
        queues = [deque(q) for q in queues]
        while any(queues):
            for q in queues:
                if q:
                    s = q.popleft()
                    cost = max(0, size(s) - s.taken) + (s.parent.size if s.parent and not s.parent.taken else 0)
                    if cost > left:
                        q.clear()
                    else:
                        left -= cost
                        if size(s) > s.taken:
                            self.give(s, size(s))
        return left

    def heads(self) -> None:
        always = [[s for s in d if s.kind in ("pre", "head", "note")] for d in self.docs]
        fits = sum(s.size for d in always for s in d) <= self.budget * HEAD_SHARE
        for d in always:
            room = self.budget if fits else int(self.budget * HEAD_SHARE / len(self.docs))
            for s in d:
                if s.size <= room or room >= LEAST_ROOM:
                    self.give(s, s.cut(room))
                    room -= s.taken

    def in_order(self) -> list[list[_Segment]]:
        """Each day's open segments: the first tier with new codes, then with codes that stood among the first of an earlier day, each
        with those that quote a disclosure before; then the rest as it stands, preferred ones first."""
        seen: set[str] = set()
        out = []
        for d in self.docs:
            q = sorted((s for s in d if s.own and s.kind in ("issuer", "aux")), key=lambda s: not s.preferred)
            tier = [s for s in q if s.tier == 1]
            for s in tier:
                s.late = not s.preferred and s.code in seen
            seen |= {s.code for s in tier[:DEFER]}
            out.append(sorted(tier, key=lambda s: (s.late, not (s.preferred or s.quoted))) + [s for s in q if s.tier != 1])
        return out

    def run(self) -> None:
        if sum(s.size for s in self.all if s.own) <= self.budget:
            for s in self.all:
                s.taken = s.size if s.own else 0
            return
        self.heads()
        queues = self.in_order()
        lead, whole = lambda s: s.cut(LEAD), lambda s: s.size
        listed = lambda: sum(s.listed for q in queues for s in q if not s.taken)
        pick = lambda test: [[s for s in q if test(s)] for q in queues]
        first = lambda: pick(lambda s: s.tier == 1 and not s.taken)
        second = lambda: pick(lambda s: s.tier == 2 and not s.taken)
        others = lambda: pick(lambda s: s.kind == "aux" and not s.taken)
        left = max(0, self.budget - self.used - min(int(self.budget * LIST_SHARE), listed()))
        for_leads = int(left * (EXHAUSTIVE_LEAD_SHARE if self.exhaustive else LEAD_SHARE))
        left -= for_leads - self.rounds(first(), for_leads, lead)
        cap = max(LEAST_CAP, left // (3 * len(self.docs)))
        left = self.rounds(pick(lambda s: s.tier == 1 and 0 < s.taken < s.size), left, lambda s: s.cut(cap))
        for queue, size in ((first, lead), (second, whole), (others, whole)):
            left = self.rounds(queue(), left, size)
        spare = self.budget - self.used - listed() - LISTING_HEAD * len(self.docs)
        for queue, size in ((first, lead), (second, whole), (others, whole)):
            spare = self.rounds(queue(), spare, size) if spare > 0 else 0


def digest_plan(segments: DataFrame, budget: int, exhaustive: bool = False, preferred: frozenset[str] = frozenset()) -> DataFrame:
    """Bytes that a request reads of each segment: rows (request, doc, place, taken, late). segments: those of `sized` with request, day,
    cat and head_only (a summary that is read beside the same day's detail file gives its head and aux sections only).

    All that is asked for, if it fits. Else pre and head sections first, up to 60 % of the budget, then turn by turn over the days in
    order of (day, cat): leads of first-tier sections from 55 % (exhaustive: 40 %) of what is left beside a reserve for the listing; these
    sections up to a cap; leads that were not reached; the second tier; aux sections; last what the listing doesn't need, in the same
    order. A section brings its intro. Codes that stood first on an earlier day come last on a later one. An appendix is an aux section of an
    exhaustive request; else a note of its heading stands for it, among the heads. A
    plan takes the sizes of one request's segments, not their texts, and holds one request at a time; nothing but a cut first line of a head can pass the budget."""

    def plan(rows: list[tuple]) -> tuple[list[int], list[bool]]:
        """One request's rows (day, cat, doc, place, kind, code, tier, parent, size, lines, quoted, listed, head_only) in order."""
        every, docs = [], []
        for _, day in groupby(rows, key=itemgetter(0, 1, 2)):
            own, parents = {}, []
            for _, _, _, place, kind, code, tier, parent, *rest in day:
                s = own[place] = _Segment(len(every), kind, code, tier, *rest, preferred, exhaustive)
                every.append(s)
                if parent is not None:
                    parents.append((s, parent))
            for s, parent in parents:
                s.parent = own[parent]
            docs.append(list(own.values()))
        _Plan(docs, budget, exhaustive).run()
        return [s.taken for s in every], [s.late for s in every]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests pass through one after the other; the end of a batch may cut one, whose rows wait for the next."""

        def planned(request) -> pa.RecordBatch:
            taken, late = plan(rows)
            docs, places = pa.array([r[2] for r in rows], types[1]), pa.array([r[3] for r in rows], types[2])
            return pa.RecordBatch.from_arrays([pa.array([request] * len(rows), types[0]), docs, places, pa.array(taken, pa.int64()), pa.array(late, pa.bool_())], ["request", "doc", "place", "taken", "late"])

        rows, last = [], None
        for batch in batches:
            types = [batch.schema.field(c).type for c in ("request", "doc", "place")]
            ends, sizes = batch.column("lines").offsets.to_numpy(), batch.column("lines").values.to_numpy(zero_copy_only=False)
            columns = [batch.column(c).to_pylist() for c in ORDERED] + [[sizes[a:b] for a, b in pairwise(ends)] if c == "lines" else batch.column(c).to_pylist() for c in READ]
            for request, row in zip(batch.column("request").to_pylist(), zip(*columns)):
                if rows and request != last:
                    yield planned(last)
                    rows = []
                last = request
                rows.append(row)
        if rows:
            yield planned(last)

    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    asked = segments.select("request", *ORDERED, *READ).repartition("request").sortWithinPartitions("request", *(F.asc_nulls_last(c) for c in ORDERED))
    return asked.mapInArrow(run, f"request {kinds['request']}, doc {kinds['doc']}, place {kinds['place']}, taken bigint, late boolean")
