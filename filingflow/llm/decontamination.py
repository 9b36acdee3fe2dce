"""Benchmark decontamination with a distributed positional inverted index.

`build_index` stores the postings of every training token, in shards of whole documents: for each term of a shard the sorted
positions where it stands. `search` takes the windows of the test items, starts from each window's rarest term in the whole corpus
and intersects the offset-adjusted lists of the other terms, rarest first, until only exact occurrences are left. Both run shard by
shard without a shuffle; only the counts of test terms, which decide what is rare, are summed over the shards.

Test windows are a table and are searched in blocks, one after the other. Nulls: a null text has no words; a null document or item id
is kept, an item without words has no window. Repeated rows each give
their own row. Terms are 64-bit hashes of words, so an occurrence is ten equal hashes in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import ALNUM, U64, WordHasher, cut, give_back, packed, stored, text_slices, without_ids

INDEX = "shard bigint, documents array<struct<doc_id:bigint,n_words:bigint>>, first binary, terms binary, term_at binary, positions binary"
#: Windows that one block of test items holds, about; blocks are searched one after the other.
BLOCK_WINDOWS = 100_000


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a shard of about 1 MB of text: its number (of the task and within it), documents, where the words of each begin, terms
    and their positions."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, task, number = WordHasher(*ALNUM), TaskContext.get().partitionId(), 0
        kinds = [pa.int64(), pa.list_(pa.struct([("doc_id", pa.int64()), ("n_words", pa.int64())])), *[pa.binary()] * 4]
        for batch in batches:
            for s in text_slices(batch.column(1)):
                words = hasher(s)
                order = np.argsort(words.hashes, kind="stable")
                ranked = words.hashes[order]
                heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
                own = [{"doc_id": i, "n_words": n} for i, n in zip(batch.column(0).slice(s.lo, s.hi - s.lo).to_pylist(), np.diff(words.first).tolist())]
                row = [(task << 32) + number, own, packed(words.first.astype(np.uint32)), packed(ranked[heads]), packed(np.r_[heads, len(ranked)].astype(np.uint32)), packed(order.astype(np.uint32))]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["shard", "documents", "first", "terms", "term_at", "positions"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(shards, INDEX)


def test_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Rows (item, size, words): the word hashes of each window of the test items; an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(*ALNUM)
        for batch in batches:
            for s in text_slices(batch.column(1)):
                words = hasher(s)
                ids, out = [], []
                for k, item in enumerate(batch.column(0).slice(s.lo, s.hi - s.lo).to_pylist()):
                    own = words.hashes[words.first[k] : words.first[k + 1]]
                    for i in range(max(1, len(own) - window + 1) if len(own) else 0):
                        ids.append(item)
                        out.append(packed(own[i : i + window]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["item", "words"])

    return items.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "item bigint, words binary")


def _term_counts(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each term of a block stands in the corpus; what comes back is bounded by the block's vocabulary."""
    known = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for batch in batches:
            for terms, at in zip(batch.column("terms"), batch.column("term_at")):
                terms, at = np.frombuffer(terms.as_buffer(), U64), np.frombuffer(at.as_buffer(), np.uint32).astype(np.int64)
                own = np.searchsorted(known.value, terms)
                own[own == len(known.value)] = 0
                hit = known.value[own] == terms if len(known.value) else np.zeros(len(terms), bool)
                total[own[hit]] += np.diff(at)[hit]
        yield pa.RecordBatch.from_pydict({"term": np.flatnonzero(total), "n": total[total > 0]})

    sums = index.select("terms", "term_at").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in sums.collect()}


class _Block(NamedTuple):
    """Windows as a matrix of term numbers in order of rarity, with the offset of each in its window; -1 fills short ones."""

    ids: list
    size: np.ndarray
    vocabulary: np.ndarray
    term: np.ndarray
    offset: np.ndarray


def _by_rarity(ids: list, windows: list[np.ndarray], vocabulary: np.ndarray, counts: np.ndarray) -> tuple:
    """The fields of a _Block."""
    width = max(map(len, windows))
    term, offset = np.full((len(windows), width), -1), np.zeros((len(windows), width), np.int64)
    for k, w in enumerate(windows):
        terms = np.searchsorted(vocabulary, w)
        order = np.lexsort((np.arange(len(w)), counts[terms]))
        term[k, : len(w)], offset[k, : len(w)] = terms[order], order
    return ids, np.array([len(w) for w in windows]), vocabulary, term, offset


def test_blocks(index: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[tuple]:
    """The test windows in blocks of about BLOCK_WINDOWS, rarest terms first by counts over the whole corpus. The windows are a table;
    one block at a time comes to the driver and from there to the tasks."""
    windows = cut(test_windows(items, id_col, text_col, window))
    n = max(1, -(-windows.count() // BLOCK_WINDOWS))
    for k in range(n):
        rows = windows.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k).toArrow()
        if rows.num_rows:
            own = [np.frombuffer(x, U64) for x in rows.column("words").to_pylist()]
            vocabulary = np.unique(np.concatenate(own))
            found = _term_counts(index, vocabulary)
            yield _by_rarity(rows.column("item").to_pylist(), own, vocabulary, np.array([found.get(t, 0) for t in range(len(vocabulary))]))


def _in_blocks(index: DataFrame, blocks: Iterator[tuple], find, schema: str) -> DataFrame:
    """What find(shard, block) gives for every shard of the index and every block, as rows of the schema after (shard, ids)."""
    parts = []
    for block in blocks:
        shared = index.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = _Block(*shared.value)
            for batch in batches:
                for number, documents, *own in zip(*batch.columns):
                    shard = _Shard(*(x.as_buffer() for x in own))
                    shard.restrict(block.vocabulary)
                    out = find(number.as_py(), [d["doc_id"].as_py() for d in documents], shard, block)
                    if out.num_rows:
                        yield out
                give_back()

        # Each block's rows are written before the next one is sent.
        parts.append(cut(index.mapInArrow(run, schema)))
        shared.unpersist()
    if not parts:
        return index.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class _Shard:
    """A shard's postings as sorted keys (test term << 32 | position)."""

    def __init__(self, first: pa.Buffer, terms: pa.Buffer, term_at: pa.Buffer, positions: pa.Buffer):
        self.first = np.frombuffer(first, np.uint32).astype(np.int64)
        self.terms, self.at = np.frombuffer(terms, U64), np.frombuffer(term_at, np.uint32).astype(np.int64)
        self.positions = np.frombuffer(positions, np.uint32)

    def restrict(self, vocabulary: np.ndarray) -> None:
        k = np.minimum(np.searchsorted(self.terms, vocabulary), max(0, len(self.terms) - 1))
        known = self.terms[k] == vocabulary if len(self.terms) else np.zeros(len(vocabulary), bool)
        lo, hi = np.where(known, self.at[k], 0), np.where(known, self.at[k + 1], 0) if len(self.terms) else np.zeros(len(vocabulary), np.int64)
        self.n = hi - lo
        end = np.cumsum(self.n)
        self.list_at = np.r_[0, end]
        take = np.arange(end[-1]) - np.repeat(end - self.n, self.n) + np.repeat(lo, self.n)
        self.keys = (np.repeat(np.arange(len(vocabulary)), self.n) << 32) | self.positions[take].astype(np.int64)

    def candidates(self, block: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose terms all occur here, with each position of their rarest term."""
        possible = np.flatnonzero(((self.n[block.term] > 0) | (block.term < 0)).all(1))
        rare = block.term[possible, 0]
        size = self.n[rare]
        end = np.cumsum(size)
        take = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size) + np.repeat(self.list_at[rare], size)
        return np.repeat(possible, size), self.keys[take] & 0xFFFFFFFF

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) | np.maximum(position, 0)
        k = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return (self.keys[k] == key) & (position >= 0) if len(self.keys) else np.zeros(len(key), bool)

    def near(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, (term << 32) | hi, "right") > np.searchsorted(self.keys, (term << 32) | lo)

    def exact(self, block: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Window and start of each exact occurrence."""
        which, at = self.candidates(block)
        start = at - block.offset[which, 0]
        row = np.searchsorted(self.first, at, "right") - 1
        ok = (start >= self.first[row]) & (start + block.size[which] <= self.first[row + 1])
        which, start = which[ok], start[ok]
        for k in range(1, block.term.shape[1]):
            term = block.term[which, k]
            ok = (term < 0) | self.has(np.maximum(term, 0), start + block.offset[which, k])
            which, start = which[ok], start[ok]
        return which, start

    def close(self, block: _Block, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Window and position of each occurrence of its rarest term that has all its other terms within slop words, in any order."""
        which, at = self.candidates(block)
        row = np.searchsorted(self.first, at, "right") - 1
        lo, hi = np.maximum(at - slop, self.first[row]), np.minimum(at + slop, self.first[row + 1] - 1)
        for k in range(1, block.term.shape[1]):
            term = block.term[which, k]
            ok = (term < 0) | self.near(np.maximum(term, 0), lo, hi)
            which, at, lo, hi = which[ok], at[ok], lo[ok], hi[ok]
        return which, at


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, slop: int | None = None) -> DataFrame:
    """Rows (doc_id, item_id, position) of matches: exact phrases by their first word, or with slop proximity matches by their
    rarest word, counted in words from 0. Each (window, position) gives a row; repeated windows of an item repeat."""

    def find(number: int, ids: list, shard: _Shard, block: _Block) -> pa.RecordBatch:
        which, at = shard.exact(block) if slop is None else shard.close(block, slop)
        row = np.searchsorted(shard.first, at, "right") - 1
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[r] for r in row], pa.int64()), "item_id": pa.array([block.ids[w] for w in which], pa.int64()), "position": at - shard.first[row]})

    return _in_blocks(index, test_blocks(index, items, id_col, text_col, window), find, "doc_id bigint, item_id bigint, position bigint")


def report(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """One row a document of the index: how many of its words exact occurrences cover, and which items occur. An item without id
    counts as an item, but has no name in the digest."""

    def find(number: int, ids: list, shard: _Shard, block: _Block) -> pa.RecordBatch:
        which, start = shard.exact(block)
        row = np.searchsorted(shard.first, start, "right") - 1
        # Of each document and item, the runs of words that its occurrences cover.
        hits = sorted({(r, block.ids[w], lo, n) for r, w, lo, n in zip(row.tolist(), which.tolist(), (start - shard.first[row]).tolist(), block.size[which].tolist())}, key=lambda x: (x[0], x[2]))
        columns = zip(*hits) if hits else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array([number] * len(hits), pa.int64()), *(pa.array(x, pa.int64()) for x in columns)], ["shard", "row", "item", "lo", "n"])

    hits = _in_blocks(index, test_blocks(index, items, id_col, text_col, window), find, "shard bigint, row bigint, item bigint, lo bigint, n bigint")
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("lo", "n")), lambda s: F.sequence(s["lo"], s["lo"] + s["n"] - 1)))))
    names = F.array_sort(F.collect_set(F.col("item").cast("string")))
    found = hits.groupBy("shard", "row").agg(covered.cast("bigint").alias("n_hit"), (F.size(names) + F.max(F.col("item").isNull().cast("int"))).cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    each = index.select("shard", F.posexplode("documents").alias("row", "d")).select("shard", F.col("row").cast("bigint").alias("row"), "d.*")
    joined = each.join(found, ["shard", "row"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.lit(empty)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontamination_report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    return report(stored(build_index(docs), "postings"), items, window=window)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without those that hold a window of a test item. Rows that share an id go or stay together."""
    return without_ids(docs, "doc_id", decontamination_report(docs, items, window).where("contaminated").select("doc_id"))
