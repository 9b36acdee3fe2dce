"""Ranked lexical search: Block-Max MaxScore over an inverted index in shards.

`build_index` stores, for shards of about SHARD_BYTES of text, the postings of every term in blocks of up to BLOCK postings. A block
is packed bytes (gaps between documents, counts of the term) and has its last document, its highest count and its shortest document's
length beside it: the score's part of a document grows with the count and falls with the length, so these two bound it for any statistics
of the corpus, and the index needs only one pass.

`search` takes items as queries, one block of items after the other. The statistics of their terms are summed over all shards. Each task
then keeps one heap an item while it goes through its shards. In a shard, terms are ordered by the bound of their whole list; those
whose bounds together stay below the heap's least score are non-essential. Essential lists are unpacked and summed; a candidate whose
sum and block maxima of the non-essential lists don't reach the heap is rejected before any of these blocks is unpacked, and of the rest
only blocks that hold a surviving candidate are. Last, the heaps of all tasks are merged in Spark.

Terms are told apart by 64-bit hashes. A null text has no terms; a document without terms counts for nothing and is never returned. Rows
of documents that share an id are documents of their own; equal scores go by ascending id, null ids last, then to either row. Each row of
the items gives its own ranks, also where ids repeat or are null; an item without terms, or whose terms stand in no document, gives none.
Integers are 64 bits: a score's part stays below 10**6 times its weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.llm.common import ALNUM, U64, WordHasher, cut, give_back, packed, stored, text_slices

#: Text of a shard, about; postings of a block; items that are searched at once.
SHARD_BYTES, BLOCK, BLOCK_ITEMS = 1 << 24, 64, 2048
INDEX = "n_docs bigint, n_words bigint, doc_ids array<bigint>, lengths binary, terms binary, df binary, block_at binary, last binary, most binary, least binary, byte_at binary, widths binary, body binary"
_COLUMNS = [c.split()[0] for c in INDEX.split(", ")]


def _postings(slices: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, count) sorted by term and document, from each slice's word hashes and documents."""
    hashes, doc = (np.concatenate(x) for x in zip(*slices))
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], doc[order]
    heads = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[heads], doc[heads], np.diff(np.r_[heads, len(hashes)])


def _width(x: np.ndarray) -> np.ndarray:
    """Bytes that hold a number: 1, 2 or 4."""
    return np.where(x < 1 << 8, 1, np.where(x < 1 << 16, 2, 4))


def _put(body: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    for k in range(4):
        on = width > k
        body[at[on] + k] = (value[on] >> (8 * k)) & 255


def _index_row(doc_ids: list, lengths: np.ndarray, slices: list) -> pa.RecordBatch:
    term, doc, count = _postings(slices)
    heads = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    df = np.diff(np.r_[heads, len(term)])
    n_blocks = -(-df // BLOCK)
    block_at = np.r_[0, np.cumsum(n_blocks)]
    inside = np.arange(block_at[-1]) - np.repeat(block_at[:-1], n_blocks)
    start = np.repeat(heads, n_blocks) + inside * BLOCK
    size = np.diff(np.r_[start, len(term)])
    if len(term):
        gap = doc.copy()
        gap[1:] -= doc[:-1]
        gap[start] = doc[start]  # a block can be unpacked by itself
        last, most, least = doc[start + size - 1], np.maximum.reduceat(count, start), np.minimum.reduceat(lengths[doc], start)
        gap_width, count_width = _width(np.maximum.reduceat(gap, start)), _width(most)
        byte_at = np.r_[0, np.cumsum(size * (gap_width + count_width))]
        place = np.arange(len(term)) - np.repeat(start, size)
        body = np.zeros(byte_at[-1], np.uint8)
        own, own_count = np.repeat(gap_width, size), np.repeat(count_width, size)
        at = np.repeat(byte_at[:-1], size)
        _put(body, at + place * own, gap, own)
        _put(body, at + np.repeat(size * gap_width, size) + place * own_count, count, own_count)
    else:
        last = most = least = gap_width = count_width = np.zeros(0, np.int64)
        byte_at, body = np.zeros(1, np.int64), np.zeros(0, np.uint8)
    values = [int((lengths > 0).sum()), int(lengths.sum()), doc_ids, *map(packed, (lengths.astype(np.uint32), term[heads], df.astype(np.uint32), block_at.astype(np.uint32), last.astype(np.uint32), most.astype(np.uint32), least.astype(np.uint32), byte_at.astype(np.int64), (gap_width * 8 + count_width).astype(np.uint8), body))]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 10]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], _COLUMNS)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a shard, see INDEX. No shuffle: a shard's documents are those of its task in order."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ids, lengths, slices, held = WordHasher(*ALNUM), [], [], [], 0
        for batch in batches:
            for s in text_slices(batch.column(1)):
                words = hasher(s)
                n = np.diff(words.first)
                slices.append((words.hashes, np.repeat(np.arange(len(n)) + len(ids), n)))
                ids.extend(batch.column(0).slice(s.lo, s.hi - s.lo).to_pylist())
                lengths.append(n)
                held += len(s.data)
                if held >= SHARD_BYTES:
                    yield _index_row(ids, np.concatenate(lengths), slices)
                    ids, lengths, slices, held = [], [], [], 0
                    give_back()
        if ids:
            yield _index_row(ids, np.concatenate(lengths), slices)
        give_back()

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(shards, INDEX)


class _Items(NamedTuple):
    """A block of items: the terms of all (sorted hashes), their weights, corpus figures, and of each item its terms with repeats."""

    vocabulary: np.ndarray
    weight: np.ndarray
    n_docs: int
    n_words: int
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item_id, words): the hashes of an item's terms in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(*ALNUM)
        for batch in batches:
            for s in text_slices(batch.column(1)):
                words = hasher(s)
                own = [packed(words.hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(own, pa.binary())], ["item_id", "words"])

    return items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string")).mapInArrow(run, "item_id bigint, words binary")


def _document_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents hold each term of a block; what comes back is bounded by the block's vocabulary."""
    known = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for batch in batches:
            for terms, df in zip(*batch.columns):
                terms, df = np.frombuffer(terms.as_buffer(), U64), np.frombuffer(df.as_buffer(), np.uint32)
                k, hit = _found(terms, known.value)
                total[hit] += df[k[hit]]
        yield pa.RecordBatch.from_pydict({"term": np.flatnonzero(total), "n": total[total > 0]})

    rows = index.select("terms", "df").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out


def _found(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted hash stands among sorted terms, and whether it does."""
    k = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
    return k, terms[k] == wanted if len(terms) else np.zeros(len(wanted), bool)


class Ranking(NamedTuple):
    """The integer scoring rule: a document's part of a term's score is weight * (scale * tf div (scale_tf * tf + length_tf * m)),
    m = 100 - slope + (slope * length * documents) div words."""

    scale: int = 1_000_000_000
    scale_tf: int = 1000
    length_tf: int = 12
    slope: int = 25

    def part(self, tf: np.ndarray, length: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
        m = 100 - self.slope + (self.slope * length.astype(np.int64) * n_docs) // max(n_words, 1)
        tf = tf.astype(np.int64)
        return (self.scale * tf) // (self.scale_tf * tf + self.length_tf * m)

    def weights(self, df: np.ndarray, n_docs: int) -> np.ndarray:
        return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class _Shard:
    """A shard's lists of the terms of a block of items; lists and blocks are unpacked when they are asked for."""

    def __init__(self, columns: dict, items: _Items, rule: Ranking):
        take = lambda name, kind: np.frombuffer(columns[name].as_buffer(), kind)
        self.items, self.rule = items, rule
        self.doc_ids = columns["doc_ids"].values.to_numpy(zero_copy_only=False) if columns["doc_ids"].values.null_count == 0 else np.array([np.iinfo(np.int64).max if x is None else x for x in columns["doc_ids"].as_py()], np.int64)
        self.no_id = {k for k, x in enumerate(columns["doc_ids"].values.is_null().to_pylist()) if x} if columns["doc_ids"].values.null_count else set()
        self.lengths, self.body = take("lengths", np.uint32), take("body", np.uint8)
        k, self.known = _found(take("terms", U64), items.vocabulary)
        block_at = take("block_at", np.uint32).astype(np.int64)
        self.lo, self.hi = np.where(self.known, block_at[k], 0), np.where(self.known, block_at[np.minimum(k + 1, len(block_at) - 1)], 0)
        self.last, self.byte_at, self.widths = take("last", np.uint32), take("byte_at", np.int64), take("widths", np.uint8)
        self.bound = rule.part(take("most", np.uint32), take("least", np.uint32), items.n_docs, items.n_words)
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.list_bound = np.array([self.bound[a:b].max(initial=0) for a, b in zip(self.lo, self.hi)], np.int64) * items.weight

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of blocks, one after the other."""
        docs, counts = [], []
        for b in which.tolist():
            lo, hi = int(self.byte_at[b]), int(self.byte_at[b + 1])
            g, c = int(self.widths[b]) >> 3, int(self.widths[b]) & 7
            mid = lo + (hi - lo) // (g + c) * g
            docs.append(np.cumsum(self.body[lo:mid].view(f"<u{g}"), dtype=np.int64))
            counts.append(self.body[mid:hi].view(f"<u{c}"))
        return np.concatenate(docs), np.concatenate(counts)

    def parts(self, term: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term's list, or of some of its blocks, with its weighted part of their scores."""
        if which is None and term in self.unpacked:
            return self.unpacked[term]
        docs, counts = self.blocks(np.arange(self.lo[term], self.hi[term]) if which is None else which)
        out = docs, self.items.weight[term] * self.rule.part(counts, self.lengths[docs], self.items.n_docs, self.items.n_words)
        if which is None:
            self.unpacked[term] = out
        return out

    def best(self, item: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among an item's k best, given the least score of its heap so far, and their scores."""
        own = slice(self.items.first[item], self.items.first[item + 1])
        term, times = self.items.term[own], self.items.times[own]
        bounds = self.list_bound[term] * times
        on = bounds > 0
        order = np.argsort(bounds[on], kind="stable")
        term, times, bounds = term[on][order], times[on][order], bounds[on][order]
        below = np.cumsum(bounds)
        n = int(np.searchsorted(below, least, "left"))
        if n == len(term):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(len(self.lengths), np.int64)
        for t, x in zip(term[n:].tolist(), times[n:].tolist()):
            docs, part = self.parts(t)
            score[docs] += part * x
        docs = np.flatnonzero(score)
        score = score[docs]
        if not n:
            return docs, score
        # A block's maximum bounds what a non-essential list can add to a document that lies in it.
        if len(score) > k:
            least = max(least, int(np.partition(score, -k)[-k]))
        block = [self.lo[t] + np.searchsorted(self.last[self.lo[t] : self.hi[t]], docs) for t in term[:n].tolist()]
        rest = np.stack([np.where(b < self.hi[t], self.bound[np.minimum(b, self.hi[t] - 1)], 0) * (self.items.weight[t] * x) for b, t, x in zip(block, term[:n].tolist(), times[:n].tolist())])
        left = rest.sum(0)
        for j in range(n - 1, -1, -1):
            keep = score + left >= least
            if not keep.all():
                docs, score, left, rest, block = docs[keep], score[keep], left[keep], rest[:, keep], [b[keep] for b in block]
            if not len(docs):
                break
            left -= rest[j]
            t = int(term[j])
            there = np.unique(block[j][block[j] < self.hi[t]])
            if len(there):
                own, part = self.parts(t, there)
                at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                score += np.where(own[at] == docs, part[at], 0) * times[j]
        return docs, score


def _block_search(index: DataFrame, rows: pa.Table, k: int, totals: tuple[int, int], rule: Ranking) -> DataFrame:
    """Rows (item, doc_id, score): the k best of each task for each item of a block, items by their place in it."""
    own = [np.frombuffer(x, U64) for x in rows.column("words").to_pylist()]
    vocabulary = np.unique(np.concatenate(own))
    terms = [np.unique(np.searchsorted(vocabulary, x), return_counts=True) for x in own]
    df = _document_counts(index, vocabulary)
    first = np.r_[0, np.cumsum([len(t) for t, _ in terms])].astype(np.int64)
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    items = _Items(vocabulary, np.where(df > 0, rule.weights(df, totals[0]), 0), *totals, first, join([t for t, _ in terms]), join([c for _, c in terms]))
    shared = index.sparkSession.sparkContext.broadcast(tuple(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(*shared.value)
        n = len(items.first) - 1
        heaps = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(n)]
        for batch in batches:
            for row in range(batch.num_rows):
                s = _Shard({c: batch.column(i)[row] for i, c in enumerate(batch.schema.names)}, items, rule)
                for item in range(n):
                    ids, scores, none = heaps[item]
                    docs, more = s.best(item, k, int(scores[-1]) if len(scores) == k else 1)
                    if len(docs):
                        ids, scores, none = np.r_[ids, s.doc_ids[docs]], np.r_[scores, more], np.r_[none, np.isin(docs, list(s.no_id))]
                        order = np.lexsort((ids, none, -scores))[:k]
                        heaps[item] = ids[order], scores[order], none[order]
            give_back()
        for lo in range(0, n, 256):
            part = heaps[lo : lo + 256]
            ids, scores, none = (np.concatenate([h[j] for h in part]) for j in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(lo, lo + len(part)), [len(h[0]) for h in part])), pa.array(ids, mask=none), pa.array(scores)], ["item", "doc_id", "score"])

    found = index.select("doc_ids", "lengths", "terms", "block_at", "last", "most", "least", "byte_at", "widths", "body").mapInArrow(run, "item bigint, doc_id bigint, score bigint")
    names = index.sparkSession.createDataFrame(pa.table({"item": pa.array(np.arange(rows.num_rows)), "item_id": rows.column("item_id")}))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", rule: Ranking = Ranking()) -> DataFrame:
    """Rows (item_id, rank, doc_id, score) of each item's k documents with the highest scores above 0."""
    spark = index.sparkSession
    total = index.agg(F.sum("n_docs").alias("d"), F.sum("n_words").alias("w")).first()
    terms = cut(_item_terms(items, id_col, text_col))
    n = max(1, -(-terms.count() // BLOCK_ITEMS))
    # Equal items are told apart by their place, so that a block is bounded whatever the items are.
    placed = terms.withColumn("_place", F.monotonically_increasing_id())
    parts = []
    for b in range(n):
        rows = placed.where(F.pmod(F.xxhash64("_place"), F.lit(n)) == b).drop("_place").toArrow()
        if rows.num_rows and total.d:
            found = _block_search(index, rows, k, (total.d, total.w), rule)
            # Each block's rows are written before the next one is sent.
            parts.append(found if n == 1 else cut(found))
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    return search(stored(build_index(docs), "ranked"), items, k)
