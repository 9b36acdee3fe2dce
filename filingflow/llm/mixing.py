"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of its documents in a shuffled but fixed order (by md5 of the id), cut into blocks of `block_chars`
characters. Weights are whole numbers h out of a period H. In a period, block i of a source with h blocks is released at slot
floor(i * H / h) and due before slot ceil((i + 1) * H / h); every slot takes the released block that is due first. On one line of
slots that order meets every deadline, so at every slot each source is less than one block from its exact share. The schedule
repeats with the period, hence a document's slot follows from its block number and a table of one period.

No row is dropped: whole periods run while every source can fill its part; then one closing period with what the short sources have
left (its shares are those of what it holds), and the others go on with their own weights. A source without weight comes after all
others, as a mixture of its own. Sources go round `max_sources` bundles (those without weight round as many others), the bundles are
scheduled, and a bundle's slots are dealt out among its sources by a schedule of their own, made in Spark; that is one rule for any
number of sources. A source is less than one block from its share of the bundle, and the bundle less than one block from its share of
all; alone in its bundle, as each is until there are more sources than bundles, a source is less than one block off. Equal source
names are one source; null is a source of its own. Null and empty texts take no room and stand where the block before them ends. Rows
of one id stand together. Weights of absent sources have no effect.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.llm.common import cut

#: Bundles of sources that one schedule holds; its size grows with their square.
MAX_SOURCES = 2000
#: Tasks among which a source's rows are dealt out where plans are joined.
SALT = 64


def earliest_deadline_first(shares: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in a period that holds shares[s] blocks of s."""
    total = sum(shares.values())
    windows = sorted((i * total // h, -(-(i + 1) * total // h), s, i) for s, h in shares.items() for i in range(h))
    ready: list[tuple] = []
    slots: dict[str, list[int]] = {s: [0] * h for s, h in shares.items()}
    k = 0
    for slot in range(total):
        while k < len(windows) and windows[k][0] <= slot:
            release, due, s, i = windows[k]
            heapq.heappush(ready, (due, s, i))
            k += 1
        due, s, i = heapq.heappop(ready)
        slots[s][i] = slot
    return slots


def whole_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole numbers that sum to the period, by largest remainders; each is 1 at least."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    while (left := period - sum(out.values())) != 0:
        for s in order if left > 0 else [s for s in reversed(order) if out[s] > 1]:
            out[s] += 1 if left > 0 else -1
            left += -1 if left > 0 else 1
            if not left:
                break
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float], period: int = 1000) -> list[tuple]:
    """Rows (source, first block, blocks, first slot, blocks a period, slots a period, slots within the period), covering each
    source's blocks in order. Its size depends on the number of sources and the period only, never on the blocks."""
    out, slot = [], 0
    done = dict.fromkeys(blocks, 0)
    for group in ([s for s in blocks if weights.get(s, 0) > 0], [s for s in blocks if weights.get(s, 0) <= 0]):
        left = {s: blocks[s] for s in group if blocks[s]}
        if not left:
            continue
        h = whole_weights({s: weights.get(s, 0) if weights.get(s, 0) > 0 else blocks[s] for s in left}, max(period, 4 * len(left)))
        while left:
            full = min(left[s] // h[s] for s in left)
            closing = {s: min(h[s], left[s] - full * h[s]) for s in left if left[s] - full * h[s]}
            for times, shares in ((full, {s: h[s] for s in left}), (1, closing)):
                if times and shares:
                    at, total = earliest_deadline_first(shares), sum(shares.values())
                    for s, n in shares.items():
                        out.append((s, done[s], n * times, slot, n, total, at[s]))
                        done[s] += n * times
                        left[s] -= n * times
                    slot += times * total
            left = {s: n for s, n in left.items() if n}
    return out


def source_order(docs: DataFrame, id_col: str, source_col: str, text_col: str, hex_digits: int) -> DataFrame:
    """Rows (id, source, size, before): characters of the source ahead of each document, in md5 order, without a task that holds
    a whole source: sums of (source, first digits of md5) are added up first, then each such part is summed on its own."""
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.concat(F.when(F.col(source_col).isNull(), "-").otherwise("="), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("source"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("size"),
        F.md5(text_id.cast("binary")).alias("h"),
    ).withColumn("part", F.substring("h", 1, hex_digits))
    parts = narrow.groupBy("source", "part").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inner = Window.partitionBy("source", "part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return narrow.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, ["source", "part"]).select("id", "source", "size", (F.col("start") + F.col("inside")).alias("before"))


PLAN = "parts array<struct<first:bigint,n:bigint,slot:bigint,share:bigint,total:bigint,at:array<bigint>>>"


def plan_rows(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[tuple]:
    """schedule() as one row (source, blocks, parts) a source."""
    if len(blocks) == 1:
        return [(s, n, [(0, n, 0, 1, 1, [0])]) for s, n in blocks.items()]
    parts: dict[str, list] = {s: [] for s in blocks}
    for s, *part in schedule(blocks, weights, period):
        parts[s].append(tuple(part))
    return [(s, blocks[s], parts[s]) for s in sorted(blocks)]


def slot_of(parts: str, block: Column) -> Column:
    """The slot of a block by a column of a source's parts."""
    p = F.filter(parts, lambda p: (p["first"] <= block) & (block < p["first"] + p["n"]))[0]
    i = block - p["first"]
    return p["slot"] + F.floor(i / p["share"]).cast("bigint") * p["total"] + F.get(p["at"], (i % p["share"]).cast("int"))


def numbered(sizes: DataFrame, hex_digits: int = 3) -> DataFrame:
    """sizes with n: numbers from 0 in md5 order, those of sources with and without weight apart. Parts of the digests are counted first,
    then each is numbered on its own, so no task holds all sources."""
    s = sizes.withColumn("none", F.col("weight") <= 0).withColumn("h", F.md5(F.col("source").cast("binary"))).withColumn("part", F.substring("h", 1, hex_digits))
    ahead = Window.partitionBy("none").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = s.groupBy("none", "part").agg(F.count("*").alias("here")).select("none", "part", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("none", "part").orderBy("h", "source")) - 1
    return s.withColumn("own", own).join(starts, ["none", "part"]).select("source", "blocks", "weight", "none", (F.col("start") + F.col("own")).alias("n"))


def bundled(sizes: DataFrame, period: int, max_sources: int) -> tuple[DataFrame, DataFrame, int]:
    """sizes: rows (source, blocks, weight). Plans of the sources within their bundles, rows (source, bundle, n_blocks, parts), of the
    bundles, rows (bundle, outer), and how many bundles there are. There are max_sources bundles of sources with weight, and as many
    without, and sources go round them: as long as there are no more sources than bundles, each has a bundle of its own. Each bundle
    is scheduled in a task."""
    held = cut(numbered(sizes).select("source", "blocks", "weight", (F.col("n") % max_sources + F.when(F.col("none"), max_sources).otherwise(0)).cast("int").alias("bundle")))

    def inner(table: pa.Table) -> pa.Table:
        names, own = table.column("source").to_pylist(), dict(zip(table.column("source").to_pylist(), table.column("weight").to_pylist()))
        rows = plan_rows(dict(zip(names, table.column("blocks").to_pylist())), own, period)
        parts = [[dict(zip(("first", "n", "slot", "share", "total", "at"), p)) for p in r[2]] for r in rows]
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "n", "slot", "share", "total")] + [("at", pa.list_(pa.int64()))]))
        return pa.table({"source": [r[0] for r in rows], "bundle": pa.array([table.column("bundle")[0].as_py()] * len(rows), pa.int32()), "n_blocks": pa.array([r[1] for r in rows], pa.int64()), "parts": pa.array(parts, kind)})

    plans = held.groupBy("bundle").applyInArrow(inner, f"source string, bundle int, n_blocks bigint, {PLAN}")
    own = {r.name: r for r in held.groupBy("bundle").agg(F.min("source").alias("name"), F.sum("blocks").alias("blocks"), F.sum("weight").alias("weight")).collect()}
    outer = plan_rows({k: r.blocks for k, r in own.items()}, {k: r.weight for k, r in own.items()}, period)
    return plans, sizes.sparkSession.createDataFrame([(own[k].bundle, parts) for k, _, parts in outer], f"bundle int, {PLAN.replace('parts', 'outer', 1)}"), len(own)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = 1 << 16, period: int = 1000, temperature: float = 0.5, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", hex_digits: int = 3, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Rows (doc_id, source, n_chars, block, slot, position) for every document: the slot of the block that it begins in, and its
    place in characters in the mixture. Without weights, a source's weight is its share of characters to the power `temperature`."""
    spark = docs.sparkSession
    name = F.concat(F.when(F.col(source_col).isNull(), "-").otherwise("="), F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    sizes = cut(docs.groupBy(name.alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")).alias("n")))
    sizes = sizes.select("source", F.greatest(F.ceil(F.col("n") / block_chars), F.lit(1)).cast("bigint").alias("blocks"), F.pow(F.greatest("n", F.lit(1)).cast("double"), F.lit(temperature)).alias("weight"))
    if weights is not None:
        given = spark.createDataFrame([("-" if s is None else f"={s}", float(w)) for s, w in weights.items()], "source string, given double")
        sizes = sizes.join(given, "source", "left").select("source", "blocks", F.coalesce("given", F.lit(0.0)).alias("weight"))
    ordered = source_order(docs, id_col, source_col, text_col, hex_digits).withColumn("block", F.floor(F.col("before") / F.lit(block_chars)).cast("bigint"))
    plan, outer, bundles = bundled(sizes, period, max_sources)
    if bundles < max_sources:  # Each source has a bundle of its own, and the plans are small: the rows are the same, only the join isn't salted.
        joined = ordered.join(F.broadcast(plan.join(outer, "bundle")), "source")
    else:
        salt = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = ordered.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(salt(plan), ["source", "salt"]).join(salt(outer), ["bundle", "salt"])
    block = F.least("block", F.col("n_blocks") - 1)
    placed = joined.withColumn("offset", F.col("before") - block * block_chars).withColumn("block", block).withColumn("slot", slot_of("outer", slot_of("parts", F.col("block"))))
    return placed.select(
        F.col("id").alias("doc_id"), F.when(F.col("source") != "-", F.substring("source", 2, 1 << 30)).alias("source"), F.col("size").alias("n_chars"), "block", "slot", (F.col("slot") * block_chars + F.col("offset")).alias("position")
    )
