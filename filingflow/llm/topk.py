"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into 2, 8, 32, ... segments. Means and deviations of the segments bound the squared distance of two vectors from
below (equally, their inner product from above: sum of length * (mean * mean + deviation * deviation)), and the bound tightens from
coarse to fine. Candidates are dropped level by level against the k-th best exact score known so far; exact integer scores are
computed for the survivors only. Queries come in groups of bounded size. One group is broadcast; more are rows that meet the vectors
under (length, group, salt), so that neither the driver nor a task holds more than one group, and a task works on tiles of bounded
size whatever the bounds let through.

Components are taken as floor(scale * x), held within the range of a long, and so are scores. Null vectors and vectors with a null or
non-finite component take no part, nor does a row without id. Vectors meet only vectors of their own length. Two rows with one id are
two rows; a query row meets every row of another id. Fewer than k candidates: all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.llm.common import shuffle_width

#: Numbers of a group of queries (8 MB).
GROUP_NUMBERS = 1 << 20
#: Queries and rows of a tile, and pairs of which numbers are gathered at once.
TILE_QUERIES, TILE_ROWS, GATHERED = 512, 2048, 1 << 15


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Rows (id, v) that take part, v: array<double> of whole numbers."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("double")).alias("v"))


class Statistics:
    """Means and deviations, times the root of the length, of a matrix's segments at one level."""

    def __init__(self, m: np.ndarray, segments: int):
        at = np.linspace(0, m.shape[1], segments + 1).astype(int)
        n = np.diff(at).astype(float)
        means = np.add.reduceat(m, at[:-1], 1) / n
        deviations = np.sqrt(np.maximum(np.add.reduceat(m * m, at[:-1], 1) / n - means * means, 0))
        self.rows = np.hstack([means, deviations]) * np.tile(np.sqrt(n), 2)


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: 2, 8, 32 and so on, none finer than two components a segment."""
    return [2 * 4**j for j in range(8) if 2 * 4**j <= dim // 2]


class Block:
    """Queries of one length with their statistics at every level, and the best candidates of each so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int):
        self.rows, self.ids, self.m, self.k = rows, ids, m, k
        self.stats = [Statistics(m, s).rows for s in levels(m.shape[1])]
        self.floor, self.best = self._floors(), {}

    def _floors(self, sample: int = 2048) -> np.ndarray:
        """For each query, the k-th best score among the first queries of its group: what at least k candidates reach."""
        floor = np.full(len(self.ids), -np.inf)
        ids, m = self.ids[:sample], self.m[:sample]
        if len(ids) >= self.k and _small(self.m, m):
            for lo in range(0, len(self.ids), TILE_QUERIES):
                score = self.m[lo : lo + TILE_QUERIES] @ m.T
                score[self.ids[lo : lo + TILE_QUERIES, None] == ids[None, :]] = -np.inf
                floor[lo : lo + TILE_QUERIES] = np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        return floor

    def take(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Let the rows be candidates of all queries."""
        for a in range(0, len(ids), TILE_ROWS):
            part, own = m[a : a + TILE_ROWS], ids[a : a + TILE_ROWS]
            stats = [Statistics(part, s).rows for s in levels(m.shape[1])]
            for lo in range(0, len(self.ids), TILE_QUERIES):
                q, c, score = self._scan(slice(lo, lo + TILE_QUERIES), own, part, stats)
                self._keep(q + lo, own[c], score)

    def _scan(self, of: slice, ids: np.ndarray, m: np.ndarray, stats: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of a tile's pairs that reach the floor of their query. While many pairs are alive, bounds are a
        product of matrices; then they are taken pair by pair."""
        mine, floor = self.m[of], self.floor[of]
        alive = self.ids[of][:, None] != ids[None, :]
        level = 0
        while level < len(stats) and alive.sum() * 8 > alive.size:
            bound = self.stats[level][of] @ stats[level].T
            alive &= bound + (1e-9 * np.abs(bound) + 1e-6) >= floor[:, None]
            level += 1
        q, c = np.nonzero(alive)
        for k in range(level, len(stats)):
            bound = _inner(self.stats[k][of], stats[k], q, c)
            keep = bound + (1e-9 * np.abs(bound) + 1e-6) >= floor[q]
            q, c = q[keep], c[keep]
        if len(q) * 8 > alive.size and _small(mine, m):
            score = (mine @ m.T)[q, c]
        else:
            score = _inner(mine, m, q, c, exact=True)
        keep = score >= floor[q]
        return q[keep], c[keep], score[keep]

    def _keep(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        order = np.argsort(q, kind="stable")
        q, ids, score = q[order], ids[order], score[order]
        heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
        for a, b in zip(heads, [*heads[1:], len(q)]):
            i = int(q[a])
            old = self.best.get(i, (np.zeros(0, np.int64), np.zeros(0)))
            all_ids, all_scores = np.r_[old[0], ids[a:b]], np.r_[old[1], score[a:b]]
            top = np.lexsort((all_ids, -all_scores))[: self.k]
            self.best[i] = all_ids[top], all_scores[top]
            if len(top) == self.k:
                self.floor[i] = max(self.floor[i], float(all_scores[top][-1]))

    def found(self) -> pa.RecordBatch:
        rows = [(int(self.rows[i]), int(self.ids[i]), int(c), max(-(2**63), min(2**63 - 1, int(s)))) for i, (ids, scores) in self.best.items() for c, s in zip(ids, scores)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ([], [], [], []))], ["query_row", "query_id", "vec_id", "score"])


FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def _small(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of rows of whole numbers are exact in doubles."""
    return not (a.size and b.size) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53


def _inner(a: np.ndarray, b: np.ndarray, q: np.ndarray, c: np.ndarray, exact: bool = False) -> np.ndarray:
    """Inner products of pairs of rows, a bounded number at once; exact ones in Python's integers where doubles don't do."""
    whole = exact and not _small(a, b)
    out = np.empty(len(q), object if whole else float)
    for lo in range(0, len(q), GATHERED):
        x, y = a[q[lo : lo + GATHERED]], b[c[lo : lo + GATHERED]]
        if whole:
            out[lo : lo + GATHERED] = [sum(int(s) * int(t) for s, t in zip(r, w)) for r, w in zip(x, y)]
        else:
            out[lo : lo + GATHERED] = np.einsum("ij,ij->i", x, y)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score), both inputs as from quantised(): each query's k highest inner products, ties to smaller ids."""
    spark = vectors.sparkSession
    # One row a vector length: at most as many as the longest vector has components.
    sizes = queries.where(F.size("v") > 0).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") * F.col("dim") / GROUP_NUMBERS).cast("int"))
    numbered = queries.where(F.size("v") > 0).withColumn("query_row", F.monotonically_increasing_id())
    one = sizes.limit(2).collect()
    if not one:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if len(one) == 1 and one[0].groups == 1:
        found = _one_group(vectors, numbered, one[0].dim, k)
    else:
        found = _many_groups(vectors, numbered, sizes, k)
    w = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _one_group(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    rows = queries.toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((rows.column("query_row").to_numpy(), rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks(), dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            block = block or Block(*shared.value, k)
            block.take(batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("v"), dim))
        if block:
            yield block.found()

    return vectors.where(F.size("v") == dim).mapInArrow(run, FOUND)


def _many_groups(vectors: DataFrame, queries: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Groups of queries as rows before the vectors that they meet, under (length, group, salt)."""
    salts = shuffle_width(vectors.sparkSession)
    of = F.broadcast(sizes.select("dim", "groups"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = queries.withColumn("dim", F.size("v")).join(of, "dim").withColumn("part", F.pmod(F.xxhash64("query_row"), "groups").cast("int")).withColumn("salt", every(F.lit(salts)))
    rows = vectors.withColumn("dim", F.size("v")).join(of, "dim").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).withColumn("part", every(F.col("groups")))
    work = own.select("dim", "part", "salt", F.col("query_row"), "id", "v").unionByName(rows.select("dim", "part", "salt", F.lit(None).cast("bigint").alias("query_row"), "id", "v"))
    dealt = work.repartition(salts, "dim", "part", "salt").sortWithinPartitions("dim", "part", "salt", F.asc_nulls_last("query_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, held = None, None, []
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("dim", "part", "salt")]
            is_query = np.asarray(batch.column("query_row").is_valid())
            change = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in (*names, is_query)], axis=0)]) if batch.num_rows else []
            for a, b in zip(change, [*change[1:], batch.num_rows]):
                part, now = batch.slice(a, b - a), tuple(int(x[a]) for x in names)
                if now != key:
                    if block:
                        yield block.found()
                    key, block, held = now, None, []
                ids, m = part.column("id").to_numpy(zero_copy_only=False), _matrix(part.column("v"), now[0])
                if is_query[a]:
                    held.append((part.column("query_row").to_numpy(zero_copy_only=False).astype(np.int64), ids, m))
                elif held:
                    block = block or Block(*(np.concatenate(x) for x in zip(*held)), k)
                    block.take(ids, m)
        if block:
            yield block.found()

    return dealt.mapInArrow(run, FOUND)
