"""Removal of long repeats by recompression.

Each text is a string of word symbols. Four rounds rename it: symbols are split into left and right ones by a hash, and each left
symbol followed by a right one becomes one new symbol, named by a hash of the two, so that a pair has the same name in every document
and no dictionary has to travel. What happens to a symbol depends on its neighbours only: of a repeat of 50 words at most 15 at each
end are parsed differently, and the symbols of the 20 in the middle, of at most 16 words each, are equal wherever the repeat stands.
Each window of words is filed under its longest interior symbol, a run of windows under one symbol as one entry. Spark brings equal
symbols together; where two different texts share one, exactly the windows filed under it are compared by hashes of their words.

Equal texts are one class from the start, so copies meet once. A word is removed if a window over it also starts in a document with a
smaller id. A null text has no words; a row without id is kept as it is and nothing is removed because of it. Rows that share an id
and differ in text do not remove each other's words. Windows are 64-bit hashes of 50 word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import SPACED, U64, Buckets, WordHasher, bitmap, bucket_schema, cut, dealt_out, grams, in_bitmap, mixed, packed, shuffle_width, stored, text_slices, unpacked

WINDOW = 50
ROUNDS = 4
MARGIN = 2**ROUNDS - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def recompressed(symbol: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after the rounds, the word each begins with, and how many words it has. Pairs never cross rows."""
    start = np.arange(len(symbol))
    heads = np.zeros(len(symbol) + 1, bool)
    heads[first] = True
    for r in range(rounds):
        left = (mixed(symbol ^ U64(0xA0761D6478BD642F + r)) & U64(1)) == 0
        joins = np.zeros(len(symbol), bool)
        joins[:-1] = left[:-1] & ~left[1:] & ~heads[start[1:]]
        taken = np.zeros(len(symbol), bool)
        taken[1:] = joins[:-1]
        name = symbol.copy()
        at = np.flatnonzero(joins)
        name[at] = mixed(symbol[at] * U64(0xE7037ED1A0B428DB) + symbol[at + 1] + U64(r + 1))
        symbol, start = name[~taken], start[~taken]
    return symbol, start, np.diff(np.r_[start, first[-1] if len(first) else 0])


def filed_windows(symbol: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words within a row: its first word, and the number of the symbol that it is filed under: of those wholly
    inside its middle one with the most words, of these the smallest hash."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    end = np.cumsum(n)
    p = np.arange(end[-1] if len(end) else 0) - np.repeat(end - n, n) + np.repeat(first[:-1], n)
    if not len(p):
        return p, p
    order = np.empty(len(symbol), np.int64)
    order[np.lexsort((mixed(symbol ^ U64(0x8EBC6AF09C88C6E3)), -size))] = np.arange(len(symbol))
    lo = np.searchsorted(start, p + MARGIN)
    hi = np.searchsorted(start + size, p + window - MARGIN, "right")
    width = int((hi - lo).max())
    # Smallest of each run of 1, 2, 4, ... symbols; a range is covered by two such runs.
    table, span = [order], 1
    while span * 2 <= width:
        last = table[-1]
        table.append(np.minimum(last, np.r_[last[span:], np.full(span, len(order))]))
        span *= 2
    level = np.log2(np.maximum(hi - lo, 1)).astype(int)
    best = np.full(len(p), len(order))
    for k, t in enumerate(table):
        own = level == k
        best[own] = np.minimum(t[lo[own]], t[hi[own] - (1 << k)])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return p, place[best]


def _keys(words, n_rows: int) -> np.ndarray:
    """A hash of each row's whole word sequence."""
    out = np.zeros(n_rows, U64)
    full = np.flatnonzero(np.diff(words.first))
    if len(full):
        index = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], np.diff(words.first))
        out[full] = mixed(np.add.reduceat(mixed(words.hashes + mixed(index.astype(U64) + U64(1))), words.first[full]) + np.diff(words.first)[full].astype(U64))
    return out


FILED = {"symbol": U64, "key": U64, "lo": np.uint32, "hi": np.uint32}
PLACES = {"key": U64, "lo": np.uint32, "hi": np.uint32}
WINDOWS = {"window": U64, "key": U64, "least": np.int64, "at": np.uint32}


def texts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, key, kept_sha256): each text with its class key and the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(*SPACED)
        for batch in batches:
            for s in text_slices(batch.column(1)):
                words, raw = hasher(s), s.data.tobytes()
                digest = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(s.at[:-1].tolist(), s.at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(np.diff(words.first)), pa.array(_keys(words, s.hi - s.lo).view(np.int64)), pa.array(digest)], ["doc_id", "n_words", "key", "kept_sha256"])

    return docs.select("id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, key bigint, kept_sha256 string")


def filed(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed entries (symbol, key, first and last window) by bucket of the symbol; a task files each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, out = WordHasher(*SPACED), set(), Buckets(buckets, FILED)
        for batch in batches:
            for s in text_slices(batch.column(0)):
                words = hasher(s)
                keys = _keys(words, s.hi - s.lo)
                symbol, start, size = recompressed(words.hashes, words.first)
                p, best = filed_windows(symbol, start, size, words.first)
                if not len(p):
                    continue
                row = np.searchsorted(words.first, p, "right") - 1
                name = symbol[best]
                fresh = np.zeros(s.hi - s.lo, bool)
                for d in np.unique(row).tolist():
                    if (k := int(keys[d])) not in seen:
                        seen.add(k)
                        fresh[d] = True
                heads = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (row[1:] != row[:-1])])
                lasts = np.r_[heads[1:], len(p)] - 1
                keep = fresh[row[heads]]
                heads, lasts = heads[keep], lasts[keep]
                base = words.first[row[heads]]
                if len(heads) and out.add(name[heads], keys[row[heads]], p[heads] - base, p[lasts] - base):
                    yield from out.flush()
        yield from out.flush()

    return docs.select("text").mapInArrow(run, bucket_schema(FILED))


def shared_symbols(table: pa.Table, buckets: int) -> pa.Table:
    """Of one bucket: the entries whose symbol stands in two classes or more, dealt out by class."""
    symbol, key, lo, hi = unpacked(table, FILED)
    order = np.lexsort((key, symbol))
    symbol, key, lo, hi = symbol[order], key[order], lo[order], hi[order]
    heads = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
    change = np.r_[False, (key[1:] != key[:-1]) & (symbol[1:] == symbol[:-1])]
    shared = np.repeat(np.add.reduceat(change.astype(np.int64), heads) > 0, np.diff(np.r_[heads, len(symbol)]))
    return dealt_out(PLACES, buckets, key[shared], lo[shared], hi[shared])


def repeated_windows(table: pa.Table, buckets: int) -> pa.Table:
    """Of one bucket: the windows of each class that also stand in a document with a smaller id, dealt out by class."""
    window, key, least, at = unpacked(table, WINDOWS)
    order = np.lexsort((least, window))
    window, key, least, at = window[order], key[order], least[order], at[order]
    heads = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    smallest = np.repeat(least[heads], np.diff(np.r_[heads, len(window)]))
    later = least > smallest
    return dealt_out(PLACES, buckets, key[later], at[later], at[later])


def places_of_classes(dealt: DataFrame) -> DataFrame:
    """Rows (key, places): each class with its packed pairs of first and last window."""

    def gather(table: pa.Table) -> pa.Table:
        key, lo, hi = unpacked(table, PLACES)
        order = np.argsort(key, kind="stable")
        key, places = key[order], np.c_[lo[order], hi[order]]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return pa.table({"key": pa.array(key[heads].view(np.int64)), "places": pa.array([packed(x) for x in np.split(places, heads[1:])], pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(gather, "key bigint, places binary")


def spread(places: bytes) -> np.ndarray:
    """The windows of packed pairs, each once, in order."""
    own = np.frombuffer(places, np.uint32).reshape(-1, 2).astype(np.int64)
    n = own[:, 1] - own[:, 0] + 1
    end = np.cumsum(n)
    return np.unique(np.arange(end[-1]) - np.repeat(end - n, n) + np.repeat(own[:, 0], n))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, ...) with the text of each class. The texts are read once more; a bitmap of the keys leaves nearly all others
    where they are."""
    wanted = cut(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(*SPACED), set()
        for batch in batches:
            for s in text_slices(batch.column(0)):
                own = _keys(hasher(s), s.hi - s.lo)
                take = []
                for d in np.flatnonzero(in_bitmap(shared.value, own)).tolist():
                    if (k := int(own[d])) not in seen:
                        seen.add(k)
                        take.append(d)
                if take:
                    yield pa.RecordBatch.from_pydict({"key": pa.array(own[take].view(np.int64)), "text": batch.column(0).take(pa.array([s.lo + d for d in take]))})

    found = docs.select("text").mapInArrow(run, "key bigint, text string")
    return found.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")


def windows(flagged: DataFrame, buckets: int) -> DataFrame:
    """flagged: rows (key, text, places, least); gives packed entries (window hash, key, least id, place) of the windows filed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, out = WordHasher(*SPACED), Buckets(buckets, WINDOWS)
        for batch in batches:
            keys, least = batch.column("key").to_numpy().view(U64), batch.column("least").to_numpy()
            places = batch.column("places").to_pylist()
            for s in text_slices(batch.column("text")):
                words = hasher(s)
                hashes = grams(words.hashes, WINDOW)
                for d in range(s.hi - s.lo):
                    at = spread(places[s.lo + d])
                    k = s.lo + d
                    if out.add(hashes[words.first[d] + at], np.full(len(at), keys[k]), np.full(len(at), least[k]), at):
                        yield from out.flush()
        yield from out.flush()

    return flagged.mapInArrow(run, bucket_schema(WINDOWS))


def without(marked: DataFrame) -> DataFrame:
    """marked: rows (key, text, places); gives (key, n_removed, kept_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                words = text.encode("utf-8").split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = spread(places)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8"))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return marked.select("key", "text", "places").mapInArrow(run, "key bigint, n_removed bigint, kept_text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, kept_text) of every document; kept_text is null where no word goes or all go."""
    buckets = shuffle_width(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    each = stored(texts(docs), "texts")
    least = each.where(f"n_words >= {WINDOW} and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    shared = filed(docs, buckets).groupBy("bucket").applyInArrow(lambda t: shared_symbols(t, buckets), bucket_schema(PLACES))
    places = places_of_classes(shared).join(least, "key")
    found = windows(texts_of(docs, places), buckets).groupBy("bucket").applyInArrow(lambda t: repeated_windows(t, buckets), bucket_schema(PLACES))
    marks = places_of_classes(found)
    changed = cut(without(texts_of(docs, marks)))
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= WINDOW)
    own = F.col("doc_id") == F.col("least")
    joined = each.join(least, "key", "left").join(changed, "key", "left")
    return joined.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).when(own & F.col("kept_text").isNotNull(), F.sha2("kept_text", 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(own & ~copy, F.col("kept_text")).alias("kept_text"),
    )
