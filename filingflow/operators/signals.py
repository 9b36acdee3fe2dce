"""Signals in the history of holdings: transfers, splits, arrivals, exits, renames, co-holding clusters, and their score. Holdings
are rows (entity, party, period, shares, pct)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.operators.relational import checkpointed, components, first_per

# Weights, ranks of kinds and of tiers.
WEIGHTS = {"transfer": 3.0, "split": 5.0, "cluster": 2.0}
KIND_RANK = {"split": 6, "transfer": 5, "cluster": 4, "rename": 4, "issuer_holder": 3, "exit": 2, "new": 2, "near5": 1}
TIER_RANK = {"strong": 3, "medium": 2, "fact": 1, "weak": 0}


def usable_periods(positions: DataFrame, axis: DataFrame) -> DataFrame:
    """Rows (entity, period, n, usable): a list is usable if its numbers are in range and it is no dip, that is, not below 0.6 of
    both neighbours, of which the earlier has four parties at least, all three in range."""
    g = positions.groupBy("entity", "period").agg(F.count("*").alias("n"), F.sum("pct").alias("total"), F.bool_and((F.col("pct") >= 0) & (F.col("pct") <= 100) & (F.coalesce("shares", F.lit(0)) >= 0)).alias("ranges"))
    dense = positions.select("entity").distinct().join(F.broadcast(axis), how="cross").join(g, ["entity", "period"], "left")
    valid = dense.withColumn("valid", F.coalesce(F.col("ranges") & (F.round("total", 4) <= 100.05) & (F.col("total") >= 0), F.lit(False)))
    w = Window.partitionBy("entity").orderBy("period")
    before, after = F.lag("n").over(w), F.lead("n").over(w)
    near_valid = F.coalesce(F.lag("valid").over(w), F.lit(False)) & F.coalesce(F.lead("valid").over(w), F.lit(False))
    dip = F.coalesce(near_valid & (before >= 4) & (F.col("n") < 0.6 * F.least(before, after)), F.lit(False))
    return valid.withColumn("usable", F.col("valid") & ~dip).select("entity", "period", "n", "usable")


def changes(positions: DataFrame, usable: DataFrame) -> DataFrame:
    """Rows (entity, period, party, before, after, pct_before, pct_after) of each party between two usable neighbouring periods; a
    party not listed counts as zero here. Each holding is read once, as 'after' of its period and 'before' of the next."""
    w = Window.partitionBy("entity").orderBy("period")
    spans = usable.withColumn("next", F.lead("period").over(w)).withColumn("next_usable", F.lead("usable").over(w)).where("usable and next_usable").select("entity", F.col("period"), "next")
    before = positions.join(spans, ["entity", "period"]).select("entity", F.col("next").alias("period"), "party", F.col("shares").alias("before"), F.lit(0).cast("bigint").alias("after"), F.col("pct").alias("pct_before"), F.lit(0.0).alias("pct_after"))
    after = positions.join(spans.select("entity", F.col("next").alias("period")), ["entity", "period"]).select("entity", "period", "party", F.lit(0).cast("bigint").alias("before"), F.col("shares").alias("after"), F.lit(0.0).alias("pct_before"), F.col("pct").alias("pct_after"))
    return before.unionByName(after).groupBy("entity", "period", "party").agg(*(F.sum(c).alias(c) for c in ("before", "after", "pct_before", "pct_after")))


def block_transfers(changes: DataFrame, points: float = 1.0) -> DataFrame:
    """A party loses a block and another gains it: exactly, else within 3 %. One row a seller, its nearest buyer; weak if several
    buyers fit, strong if exact and not a round number, else medium."""
    move = F.col("after") - F.col("before")
    sellers = changes.where((F.round(F.col("pct_before") - F.col("pct_after"), 6) >= points) & (move < 0)).select("entity", "period", F.col("party").alias("seller"), (-move).alias("sold"), F.round(F.col("pct_before") - F.col("pct_after"), 6).alias("points"))
    buyers = changes.where(move > 0).select("entity", "period", F.col("party").alias("buyer"), move.alias("bought"))
    fit = sellers.join(buyers, ["entity", "period"]).where((100 * F.col("bought") >= 97 * F.col("sold")) & (100 * F.col("bought") <= 103 * F.col("sold"))).withColumn("exact", F.col("bought") == F.col("sold"))
    w = Window.partitionBy("entity", "period", "seller")
    best = fit.withColumn("any_exact", F.bool_or("exact").over(w)).where("exact or not any_exact").withColumn("candidates", F.count("*").over(w))
    best = first_per(best, ["entity", "period", "seller"], [F.asc(F.abs(F.col("bought") - F.col("sold"))), F.asc("buyer")])
    tier = F.when(F.col("candidates") > 1, "weak").when(F.col("exact") & (F.col("sold") % 100000 != 0), "strong").otherwise("medium")
    return best.select("entity", "period", "seller", "buyer", "sold", "bought", "points", "candidates", tier.alias("tier"))


def block_splits(changes: DataFrame, transfers: DataFrame, points: float = 1.0) -> DataFrame:
    """A party without transfer loses a block and 2 to 8 parties that were not there gain 0.9 to 1.1 of it together."""
    move = F.col("after") - F.col("before")
    sellers = changes.where((F.round(F.col("pct_before") - F.col("pct_after"), 6) >= points) & (move < 0)).select("entity", "period", F.col("party").alias("seller"), (-move).alias("sold"))
    sellers = sellers.join(transfers.select("entity", "period", "seller"), ["entity", "period", "seller"], "left_anti")
    new = changes.where("before = 0 and after > 0").groupBy("entity", "period").agg(F.count("*").alias("buyers"), F.sum("after").alias("bought"), F.bool_and(F.col("pct_after") < 5).alias("all_small")).where("buyers between 2 and 8")
    both = sellers.join(new, ["entity", "period"]).where((10 * F.col("bought") >= 9 * F.col("sold")) & (10 * F.col("bought") <= 11 * F.col("sold")))
    return both.select("entity", "period", "seller", "sold", "buyers", "bought", "all_small", F.when(F.col("sold") == F.col("bought"), "strong").otherwise("medium").alias("tier"))


def party_index(positions: DataFrame) -> DataFrame:
    """Per party and entity: first and last period, and percent first, last and at most."""
    g = positions.groupBy("party", "entity")
    return g.agg(F.min("period").alias("first"), F.max("period").alias("last"), F.min_by("pct", "period").alias("pct_first"), F.max_by("pct", "period").alias("pct_last"), F.max("pct").alias("pct_max"))


def _ends(usable: DataFrame) -> DataFrame:
    return usable.where("usable").groupBy("entity").agg(F.min("period").alias("begin"), F.max("period").alias("end"))


def _around(usable: DataFrame) -> DataFrame:
    """usable with the usability of the periods before and after, and the last period of the axis (one row, from the axis alone)."""
    w = Window.partitionBy("entity").orderBy("period")
    marked = usable.select("entity", "period", "usable", F.lag("usable").over(w).alias("before"), F.lead("usable").over(w).alias("next"))
    return marked.join(F.broadcast(usable.agg(F.max("period").alias("end"))))


def new_parties(index: DataFrame, usable: DataFrame, pooled: DataFrame, least: float = 2.0) -> DataFrame:
    """Arrived in a usable period after a usable one, and there with at least so much at the end of the axis, which is usable too;
    without pooled parties (party)."""
    marked = _around(usable)
    came = marked.where("usable and before").select("entity", F.col("period").alias("first"))
    there = marked.where("usable and period = end").select("entity", F.col("period").alias("last"))
    own = index.join(pooled.select("party"), "party", "left_anti").where(F.col("pct_last") >= least)
    return own.join(came, ["entity", "first"]).join(there, ["entity", "last"]).select("entity", "party", "first", F.col("pct_last").alias("pct"))


def exited_parties(index: DataFrame, usable: DataFrame, pooled: DataFrame, least: float = 2.0) -> DataFrame:
    """Last seen, with at least so much, in a usable period before a usable one; without pooled parties."""
    left = _around(usable).where("usable and next").select("entity", F.col("period").alias("last"))
    own = index.join(pooled.select("party"), "party", "left_anti").where(F.col("pct_last") >= least)
    return own.join(left, ["entity", "last"]).select("entity", "party", "last", F.col("pct_last").alias("pct"))


def near_threshold(positions: DataFrame, usable: DataFrame, pooled: DataFrame, low: float = 4.5, high: float = 5.0) -> DataFrame:
    """Just below a threshold at the end of the axis, where that is usable; without pooled parties."""
    there = _around(usable).where("usable and period = end").select("entity", "period")
    own = positions.join(pooled.select("party"), "party", "left_anti").where((F.col("pct") >= low) & (F.col("pct") < high))
    return own.join(there, ["entity", "period"]).select("entity", "party", "period", "pct")


def entity_parties(positions: DataFrame, usable: DataFrame, parties: DataFrame, entities: DataFrame) -> DataFrame:
    """Holders at the usable end of the axis that are listed entities themselves: parties (party, key), entities (entity, key) by
    equal keys of more than 3 signs."""
    listed = entities.where(F.length("key") > 3).select(F.col("entity").alias("is_entity"), "key")
    known = parties.where(F.length("key") > 3).join(listed, "key").select("party", "is_entity")
    there = _around(usable).where("usable and period = end").select("entity", "period")
    return positions.join(there, ["entity", "period"]).select("entity", "party", "pct").join(known, "party").where("entity != is_entity").select("entity", "party", "is_entity", "pct")


def renames(changes: DataFrame, pooled: DataFrame, least: int = 2) -> DataFrame:
    """The same number of shares leaves one party and arrives at another in one period, in at least so many entities."""
    c = changes.join(pooled.select("party"), "party", "left_anti")
    gone = c.where("before > 0 and after = 0").select("entity", "period", F.col("before").alias("shares"), F.col("party").alias("old"))
    came = c.where("before = 0 and after > 0").select("entity", "period", F.col("after").alias("shares"), F.col("party").alias("new"))
    both = gone.join(came, ["entity", "period", "shares"]).where("old != new").groupBy("period", "old", "new").agg(F.countDistinct("entity").alias("entities")).where(F.col("entities") >= least)
    return both.withColumn("tier", F.when(F.col("entities") >= 3, "strong").otherwise("medium"))


def merge_variants(positions: DataFrame, keys: DataFrame, axis: DataFrame) -> DataFrame:
    """Rows (entity, party, merged): spellings of one key in an entity whose series follow each other without a gap, with shares within
    0.1 % or percent within 0.05, become the earliest of their chain. keys: (party, key). Where several spellings fit one end or one
    beginning, the first by name is taken; a series is continued once and continues one. So links are a function, and the head of a
    chain is found by doubling: as many joins as the logarithm of the number of periods. The axis is numbered by one window: it is as
    long as there are periods."""
    place = axis.withColumn("place", F.row_number().over(Window.orderBy("period")))
    p = positions.join(place, "period").join(keys, "party")
    ends = {f"{c}_{side}": f(c, "place") for c in ("shares", "pct") for side, f in (("a", F.min_by), ("b", F.max_by))}
    s = p.groupBy("entity", "key", "party").agg(F.min("place").alias("a"), F.max("place").alias("b"), *(x.alias(n) for n, x in ends.items()))
    x = s.select("entity", "key", F.col("party").alias("before"), (F.col("b") + 1).alias("a"), F.col("shares_b").alias("s0"), F.col("pct_b").alias("p0"))
    y = s.select("entity", "key", "party", "a", F.col("shares_a").alias("s1"), F.col("pct_a").alias("p1"))
    near = (F.abs(F.col("s1") - F.col("s0")) * 1000 <= F.greatest("s0", F.lit(1))) | (F.abs(F.col("p1") - F.col("p0")) <= 0.05)
    fits = x.join(y, ["entity", "key", "a"]).where(near & (F.col("before") != F.col("party")))
    first = first_per(first_per(fits, ["entity", "before"], [F.asc("party")]), ["entity", "party"], [F.asc("before")])
    heads = checkpointed(first.select("entity", "party", F.col("before").alias("head")))
    for _ in range(max(1, axis.count()).bit_length()):
        jump = heads.select("entity", F.col("party").alias("head"), F.col("head").alias("further"))
        heads = checkpointed(heads.join(jump, ["entity", "head"], "left").select("entity", "party", F.coalesce("further", "head").alias("head")))
    return s.select("entity", "party").join(heads, ["entity", "party"], "left").select("entity", "party", F.coalesce("head", "party").alias("merged"))


def coholding_pairs(positions: DataFrame, pooled: DataFrame, most: int = 60, least: int = 2) -> DataFrame:
    """Pairs of parties that hold at least so many entities together. Parties of one entity only and entities with more such parties
    than `most` (a rule of the operator: such lists say nothing) are left out before pairs are made."""
    held = positions.select("party", "entity").distinct().join(pooled.select("party"), "party", "left_anti")
    several = held.join(held.groupBy("party").agg(F.count("*").alias("k")).where("k >= 2").select("party"), "party", "left_semi")
    sized = several.join(several.groupBy("entity").agg(F.count("*").alias("k")).where(F.col("k") <= most).select("entity"), "entity", "left_semi")
    x, y = sized.select("entity", F.col("party").alias("a")), sized.select("entity", F.col("party").alias("b"))
    return x.join(y, "entity").where("a < b").groupBy("a", "b").agg(F.count("*").alias("entities")).where(F.col("entities") >= least)


def clusters(pairs: DataFrame, least: int = 3, most: int = 80) -> DataFrame:
    """Rows (party, cluster) of connected pairs with so many members."""
    members = components(pairs).select(F.col("node").alias("party"), F.col("root").alias("cluster"))
    sized = members.groupBy("cluster").agg(F.count("*").alias("k")).where(F.col("k").between(least, most)).select("cluster")
    return members.join(sized, "cluster", "left_semi").select("party", "cluster")


def cluster_positions(positions: DataFrame, members: DataFrame, usable: DataFrame) -> DataFrame:
    """Clusters per entity in its last usable period, with 3 members and 5 percent together at least, against the largest other holder."""
    ends = _ends(usable).select("entity", F.col("end").alias("period"))
    last = positions.join(ends, ["entity", "period"])
    own = last.join(members, "party").groupBy("entity", "cluster").agg(F.count("*").alias("n"), F.round(F.sum("pct"), 4).alias("total"), F.sum(F.when(F.col("pct") < 5, 1).otherwise(0)).alias("small")).where("n >= 3 and total >= 5")
    others = last.join(members, "party", "left").select("entity", "pct", F.col("cluster").alias("c"))
    largest = own.select("entity", "cluster").join(others, "entity").where(~F.col("c").eqNullSafe(F.col("cluster"))).groupBy("entity", "cluster").agg(F.max("pct").alias("largest_other"))
    return own.join(largest, ["entity", "cluster"], "left").withColumn("above", F.coalesce(F.col("total") > F.col("largest_other"), F.lit(True)))


SIGNAL = ["entity", "kind", "tier", "party", "points", "pct", "small"]


def signals(transfers: DataFrame, splits: DataFrame, new: DataFrame, gone: DataFrame, near: DataFrame, cluster: DataFrame) -> DataFrame:
    """All signals as one table; points, pct and small where a kind has them."""
    null = lambda t: F.lit(None).cast(t)
    rows = [
        transfers.select("entity", F.lit("transfer").alias("kind"), "tier", F.col("seller").alias("party"), "points", null("double").alias("pct"), null("int").alias("small")),
        splits.select("entity", F.lit("split").alias("kind"), "tier", F.col("seller").alias("party"), null("double").alias("points"), null("double").alias("pct"), F.col("all_small").cast("int").alias("small")),
        new.select("entity", F.lit("new").alias("kind"), F.lit("fact").alias("tier"), "party", null("double").alias("points"), "pct", null("int").alias("small")),
        gone.select("entity", F.lit("exit").alias("kind"), F.lit("fact").alias("tier"), "party", null("double").alias("points"), "pct", null("int").alias("small")),
        near.select("entity", F.lit("near5").alias("kind"), F.lit("fact").alias("tier"), "party", null("double").alias("points"), "pct", null("int").alias("small")),
        cluster.select("entity", F.lit("cluster").alias("kind"), F.lit("medium").alias("tier"), F.col("cluster").alias("party"), F.when(F.col("above"), F.lit(3.0)).otherwise(F.lit(0.0)).alias("points"), F.col("total").alias("pct"), F.col("small").cast("int").alias("small")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def scored(signals: DataFrame) -> DataFrame:
    """Each signal with its points of the score."""
    k, pct = F.col("kind"), F.coalesce("pct", F.lit(0.0))
    points = F.coalesce("points", F.lit(0.0))
    bonus = (
        F.when(k == "transfer", F.when(F.col("tier") == "strong", 2.0).otherwise(0.0) + F.least(F.lit(3.0), points / 5))
        .when(k == "split", F.when(F.col("small") == 1, 3.0).otherwise(0.0))
        .when(k == "new", F.least(F.lit(3.0), pct / 5))
        .when(k == "exit", F.when(pct >= 5, 1.0).otherwise(0.0))
        .when(k == "cluster", F.least(F.lit(4.0), pct / 8) + points + F.least(F.lit(2.0), F.col("small") / 3))
        .otherwise(0.0)
    )
    weight = F.when(k == "transfer", 3.0).when(k == "split", 5.0).when(k == "cluster", 2.0).otherwise(1.0)
    return signals.withColumn("score", weight + bonus)


def leaderboard(signals: DataFrame, k: int = 50) -> DataFrame:
    """Entities by the sum of their signals' scores, with the number of signals and the two kinds that count most."""
    by_kind = scored(signals).groupBy("entity", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("entity").orderBy(F.desc(F.round("s", 4)), "kind")
    ranked = by_kind.withColumn("r", F.row_number().over(w))
    out = ranked.groupBy("entity").agg(F.round(F.sum("s"), 1).alias("score"), F.sum("n").alias("signals"), F.max(F.when(F.col("r") == 1, F.col("kind"))).alias("reason1"), F.max(F.when(F.col("r") == 2, F.col("kind"))).alias("reason2"))
    return out.orderBy(F.desc("score"), "entity").limit(k)


def top_signals(signals: DataFrame, k: int = 6) -> DataFrame:
    """Strong and medium signals of each entity by tier, kind and size; the first k."""
    rank = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c)), F.lit(0))
    ranked = signals.where(F.col("tier").isin("strong", "medium")).withColumn("tier_rank", rank(TIER_RANK, "tier")).withColumn("kind_rank", rank(KIND_RANK, "kind"))
    order = [F.desc("tier_rank"), F.desc("kind_rank"), F.desc_nulls_last(F.coalesce("pct", "points")), F.asc("party")]
    w = Window.partitionBy("entity").orderBy(*order)
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("entity", "place", "kind", "tier", "party")


def second_hop(top: DataFrame, index: DataFrame) -> DataFrame:
    """Parties named by an entity's top signals, and what they hold elsewhere."""
    named = top.where("kind != 'cluster'").select(F.col("entity").alias("from_entity"), "party").distinct()
    return named.join(index, "party").where("entity != from_entity").select("from_entity", "party", "entity", "pct_last")


def history(positions: DataFrame, usable: DataFrame, k: int = 15) -> DataFrame:
    """Series of each entity's k largest parties (by their highest usable percent), unusable periods masked."""
    marked = positions.join(usable.select("entity", "period", "usable"), ["entity", "period"]).withColumn("pct", F.when(F.col("usable"), F.col("pct")))
    top = first_per(marked.groupBy("entity", "party").agg(F.max("pct").alias("most")), ["entity"], [F.desc_nulls_last("most"), F.asc("party")], k)
    return marked.join(top.select("entity", "party"), ["entity", "party"], "left_semi").select("entity", "party", "period", "pct")


def find_party(positions: DataFrame, names: DataFrame, words: list[str], k: int = 40) -> DataFrame:
    """Parties whose name holds all words, with the number of entities they are in. names: (party, name)."""
    hit = names
    for w in words:
        hit = hit.where(F.upper("name").contains(w.upper()))
    return positions.join(hit, "party").groupBy("party", "name").agg(F.countDistinct("entity").alias("entities")).orderBy(F.desc("entities"), "name").limit(k)
