"""Collocations by relational mining in the manner of SETM.

Texts are cut into pieces and pieces into words; everything counts per language. The relation of occurrences R1 holds the words of all
pieces in order of (piece, position) and is stored in shards (see RELATION). Round k merge-joins neighbours: occurrences of phrases of k
words that begin at adjacent places of one piece make the occurrences of k + 1 words. These are grouped and counted, what is frequent is
kept, and semi-joined back to the occurrences (R2, R3, ..., stored too) before they are extended again. R1 is words in the same way.

Counting goes in two steps, so that what is rare, which is most, costs two or three bytes in the shuffle: first fingerprints are counted,
bits of a phrase's key as many as keep them nearly all different; then only phrases whose fingerprint is frequent are counted exactly.
What shares a fingerprint or a place of the bitmap by chance is counted too and dropped, so it costs work at most.

Phrases are told apart by 64-bit hashes of their words and language; the words of the final table are strings. A null text is empty, a
null language is `und`. Repeated rows count as often as they stand there. An empty table has no phrases. Ties go as the ranking says:
score, count, then the phrase by its bytes. Products beyond 64 bits are exact (decimals of 38 digits).
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.llm.common import SPACE, U64, TextSlice, WordHasher, Words, bitmap, cut, give_back, in_bitmap, mixed, packed, removed, shared_dir, shuffle_width, stored, text_slices

#: Pieces end at these bytes; words at these or a space or tab.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Occurrences that one bucket of counts gets, about. Text of a shard, about.
BUCKET_ROWS, SHARD_BYTES = 1 << 20, 1 << 22
#: Counted words that a task holds before it sends them off; fingerprints that it sends at once; bits of a fingerprint beyond those that
#: number the occurrences.
HELD_WORDS, FLUSH_PRINTS, SPARE_BITS = 400_000, 1_000_000, 10
#: A shard: keys of the words of each phrase that stands in it (all first words, then all second ones, ...), the number of the phrase at each occurrence in order of place, and whether
#: an occurrence begins one place after the one before, in the same piece.
RELATION = "phrases binary, numbers binary, follows binary"
#: R1 also has the words themselves, their languages and how often each stands in the shard, and the words of each language in all.
WORDS = RELATION + ", words array<string>, langs array<string>, counts array<bigint>, totals array<struct<lang:string,n:bigint>>"


def _key(words: np.ndarray) -> np.ndarray:
    """The key of each phrase (a row of word keys); of one word its own."""
    key = words[:, 0]
    for k in range(1, words.shape[1]):
        key = mixed(key * U64(0xD6E8FEB86659FD93) ^ mixed(words[:, k] + U64(0x632BE59BD9B4E019)))
    return key


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each stands there."""
    x = np.sort(x)
    heads = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[heads], np.diff(np.r_[heads, len(x)])


class _Reader:
    """Words of slices with language-specific keys: the words' own hashes, mixed with one of the language."""

    def __init__(self):
        self.hasher, self.fold, self.ends = WordHasher(SPACE[:2] + PIECE_ENDS, True), np.arange(256, dtype=np.uint8), np.zeros(256, bool)
        self.fold[65:91] += 32
        self.ends[list(PIECE_ENDS)] = True
        self.langs: dict[str, int] = {}

    def __call__(self, s: TextSlice, langs: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words, the row of each, its key, and whether it follows on the one before in one piece."""
        words = self.hasher(s)
        each = langs.slice(s.lo, s.hi - s.lo).dictionary_encode()
        salts = []
        for x in each.dictionary.to_pylist():
            if x not in self.langs:
                self.langs[x] = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
            salts.append(self.langs[x])
        row = np.repeat(np.arange(s.hi - s.lo), np.diff(words.first))
        salt = np.array(salts, U64)[each.indices.to_numpy()][row] if salts else np.zeros(0, U64)
        ended = np.zeros(len(s.data) + 1, np.int32)
        np.cumsum(self.ends[s.data], out=ended[1:])
        follows = np.zeros(len(row), bool)
        if len(row):
            follows[1:] = (row[1:] == row[:-1]) & (ended[words.start[1:]] == ended[words.end[:-1]])
        return words, row, mixed(words.hashes ^ salt), follows


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each stands first, and how often."""
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[order[heads]], order[heads], np.diff(np.r_[heads, len(keys)])


def _small(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


class _Prints:
    """Fingerprints of keys with their counts up to a limit, sorted and dealt out by their upper bits, gaps written by planes of bytes."""

    SCHEMA = "bucket int, gaps binary, counts binary"

    def __init__(self, bits: int, buckets: int, least: int):
        self.bits, self.buckets, self.least, self.held, self.n = bits, buckets, least, [], 0

    def of(self, keys: np.ndarray) -> np.ndarray:
        return keys >> U64(64 - self.bits)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.held.append((self.of(keys), np.ones(len(keys), np.int64) if counts is None else counts))
        self.n += len(keys)
        if self.n >= FLUSH_PRINTS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            prints, counts = (np.concatenate(x) for x in zip(*self.held))
            prints, sums = _summed(prints, counts)
            bucket = ((prints * U64(self.buckets)) >> U64(self.bits)).astype(np.int64)
            bounds = np.searchsorted(bucket, np.arange(self.buckets + 1))
            own = [k for k in range(self.buckets) if bounds[k] < bounds[k + 1]]
            gaps = [_planes(np.diff(prints[bounds[k] : bounds[k + 1]], prepend=U64(0))) for k in own]
            held = [packed(np.minimum(sums[bounds[k] : bounds[k + 1]], self.least).astype(np.uint16)) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(gaps, pa.binary()), pa.array(held, pa.binary())], ["bucket", "gaps", "counts"])
        self.held, self.n = [], 0

    def frequent(self, rows: DataFrame) -> DataFrame:
        """Rows (key) of the fingerprints that stand at least `least` times."""
        least = self.least

        def total(group: pa.Table) -> pa.Table:
            prints = np.concatenate([np.cumsum(_from_planes(x.as_buffer()), dtype=U64) for x in group.column("gaps").combine_chunks()])
            counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in group.column("counts").combine_chunks()]).astype(np.int64)
            prints, sums = _summed(prints, counts)
            out = pa.table({"key": prints[sums >= least].view(np.int64)})
            give_back()
            return out

        return rows.groupBy("bucket").applyInArrow(total, "key bigint")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[heads], np.add.reduceat(counts[order], heads)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, the lowest first, as many planes as the largest number has."""
    k = max(1, -(-int(x.max(initial=U64(0))).bit_length() // 8))
    return bytes([k]) + packed(x.view(np.uint8).reshape(-1, 8)[:, :k].T)


def _from_planes(buffer) -> np.ndarray:
    raw = np.frombuffer(buffer, np.uint8)
    k = int(raw[0])
    out = np.zeros(((len(raw) - 1) // k, 8), np.uint8)
    out[:, :k] = raw[1:].reshape(k, -1).T
    return out.view(np.uint64).reshape(-1)


def _prints(df: DataFrame, n_rows: int, least: int) -> _Prints:
    """Fingerprints for about so many occurrences; their length follows the data."""
    return _Prints(min(44, max(20, n_rows.bit_length() + SPARE_BITS)), max(shuffle_width(df.sparkSession), -(-n_rows // (4 * BUCKET_ROWS))), min(least, 60_000))


def word_prints(texts: DataFrame, prints: _Prints) -> DataFrame:
    """Fingerprints of all words of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            for s in text_slices(batch.column(0)):
                own, count = _distinct(reader(s, batch.column(1))[2])
                yield from prints.add(own, count)
        yield from prints.flush()
        give_back()

    return texts.mapInArrow(run, prints.SCHEMA)


def occurrences(texts: DataFrame, prints: _Prints, frequent: DataFrame) -> DataFrame:
    """R1: the occurrences of words whose fingerprint is frequent, in order of place, in shards (see WORDS)."""
    known = texts.sparkSession.sparkContext.broadcast(bitmap(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, named, totals, size = _Reader(), [], [], {}, 0

        def shard() -> pa.RecordBatch:
            keys, follows = (np.concatenate(x) for x in zip(*held))
            own, count = _distinct(keys)
            t = pa.Table.from_batches(named).combine_chunks()
            at = np.searchsorted(t["key"].to_numpy()[order := np.argsort(t["key"].to_numpy(), kind="stable")], own)
            t = t.take(order[at])
            lists = [pa.array([x], pa.list_(pa.string())) for x in (t["word"].to_pylist(), t["lang"].to_pylist())]
            sums = pa.array([[{"lang": k, "n": n} for k, n in totals.items()]], pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))
            first = _shard(own.reshape(-1, 1), np.searchsorted(own, keys), follows)
            return pa.RecordBatch.from_arrays([*first.columns, *lists, pa.array([count.tolist()], pa.list_(pa.int64())), sums], [c.split()[0] for c in WORDS.replace("<string,", "<").split(", ")])

        for batch in batches:
            for s in text_slices(batch.column(0)):
                words, row, keys, follows = reader(s, batch.column(1))
                langs = batch.column(1).slice(s.lo, s.hi - s.lo)
                for lang, n in zip(langs.to_pylist(), np.diff(words.first).tolist()):
                    if n:
                        totals[lang] = totals.get(lang, 0) + n
                kept = np.flatnonzero(in_bitmap(known.value, prints.of(keys)))
                held.append((keys[kept], follows[kept] & (np.r_[-1, kept[:-1]] == kept - 1)))
                # The words' texts: every other element of the slice cut at starts and ends of these words.
                own, first, _ = _counted(keys[kept])
                first = np.sort(kept[first])
                if len(first):
                    offsets = np.empty(2 * len(first) + 1, np.int64)
                    offsets[:-1:2], offsets[1::2], offsets[-1] = words.start[first], words.end[first], words.end[first][-1]
                    text = pa.Array.from_buffers(pa.large_string(), 2 * len(first), [None, pa.py_buffer(offsets), pa.py_buffer(reader.fold[s.data])]).take(pa.array(np.arange(len(first)) * 2)).cast(pa.string())
                    named.append(pa.RecordBatch.from_arrays([pa.array(keys[first]), text, langs.take(pa.array(row[first]))], ["key", "word", "lang"]))
                size += len(s.data)
                if size >= SHARD_BYTES and named:
                    yield shard()
                    held, named, totals, size = [], [], {}, 0
        if named:
            yield shard()
        elif totals:
            yield _only_totals(totals)
        give_back()

    return texts.mapInArrow(run, WORDS)


def _only_totals(totals: dict[str, int]) -> pa.RecordBatch:
    none = _shard(np.zeros((0, 1), U64), np.zeros(0, np.int64), np.zeros(0, bool))
    sums = pa.array([[{"lang": k, "n": n} for k, n in totals.items()]], pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))
    empty = [pa.array([[]], pa.list_(t)) for t in (pa.string(), pa.string(), pa.int64())]
    return pa.RecordBatch.from_arrays([*none.columns, *empty, sums], ["phrases", "numbers", "follows", "words", "langs", "counts", "totals"])


def word_counts(relation: DataFrame, least: int) -> DataFrame:
    """Rows (lang, word, n, key) of the words of R1 that stand at least `least` times in their language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def summed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            keys, first, _ = _counted(t["key"].to_numpy())
            _, total = _summed(t["key"].to_numpy(), t["n"].to_numpy())
            t = t.take(first).set_column(3, "n", pa.array(total))
            # In order of the words, they take less room in the shuffle.
            return t.sort_by("word").combine_chunks().to_batches()[0]

        for batch in batches:
            for phrases, words, langs, counts in zip(*batch.columns):
                keys = np.frombuffer(phrases.as_buffer(), np.int64)
                if len(keys):
                    held.append(pa.RecordBatch.from_arrays([langs.values, words.values, pa.array(keys), counts.values], ["lang", "word", "key", "n"]))
                    n += len(keys)
                if n >= HELD_WORDS:
                    out = summed()
                    held, n = [out], out.num_rows
                    if n >= HELD_WORDS // 2:
                        yield from _small(out.select(["lang", "word", "n"]))
                        held, n = [], 0
            give_back()
        if held:
            yield from _small(summed().select(["lang", "word", "n"]))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            keys = [reader(s, batch.column(0))[2] for s in text_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys).view(np.int64))], ["lang", "word", "n", "key"]) if keys else pa.RecordBatch.from_arrays([*batch.columns, pa.array([], pa.int64())], ["lang", "word", "n", "key"])

    parts = relation.select("phrases", "words", "langs", "counts").mapInArrow(run, "lang string, word string, n bigint")
    sums = parts.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return sums.mapInArrow(keyed, "lang string, word string, n bigint, key bigint")


def _shard(phrases: np.ndarray, numbers: np.ndarray, follows: np.ndarray) -> pa.RecordBatch:
    kind = np.uint16 if len(phrases) <= 1 << 16 else np.uint32
    columns = [packed(phrases.T), bytes([np.dtype(kind).itemsize]) + packed(numbers.astype(kind)), packed(np.packbits(follows))]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], ["phrases", "numbers", "follows"])


def _occurrences(row: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases (rows of k word keys), numbers and follows of a shard."""
    phrases, numbers, follows = (x.as_buffer() for x in row)
    numbers = np.frombuffer(numbers, np.uint8)
    numbers = numbers[1:].view(f"<u{numbers[0]}").astype(np.int64)
    return np.frombuffer(phrases, U64).reshape(k, -1).T, numbers, np.unpackbits(np.frombuffer(follows, np.uint8), count=len(numbers)).astype(bool)


def _pairs(row: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join of a shard's occurrences with those one place on: the phrases, where the second of each pair stands, and the pair as
    one number."""
    phrases, numbers, follows = _occurrences(row, k)
    at = np.flatnonzero(follows)
    return phrases, at, (numbers[at - 1] << 32) | numbers[at]


def _extended(phrases: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Word keys of the phrases that pairs of overlapping phrases make, one word longer."""
    return np.column_stack([phrases[pairs >> 32], phrases[pairs & 0xFFFFFFFF, -1]]) if len(pairs) else np.zeros((0, phrases.shape[1] + 1), U64)


def phrase_prints(relation: DataFrame, k: int, prints: _Prints) -> DataFrame:
    """Fingerprints of the phrases that extend the relation's k words by one; counts of a shard are summed before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                phrases, _, pair = _pairs(row, k)
                own, count = _distinct(pair)
                yield from prints.add(_key(_extended(phrases, own)), count)
        yield from prints.flush()
        give_back()

    return relation.select("phrases", "numbers", "follows").mapInArrow(run, prints.SCHEMA)


def phrase_counts(relation: DataFrame, k: int, prints: _Prints, maybe: DataFrame, n_rows: int, least: int) -> DataFrame:
    """Rows (key, n, words, firsts, rests, inside) of the phrases of k + 1 words that stand at least `least` times, from the occurrences of
    k words: keys of the words; of the first j words and of those after them for j = 1 to k; of all shorter phrases of two words or more
    in them. Only phrases whose fingerprint may be frequent are dealt out."""
    size = k + 1
    schema = pa.schema([("bucket", pa.int32()), ("counts", pa.binary()), ("words", pa.list_(pa.binary()))])
    buckets = max(shuffle_width(relation.sparkSession), -(-n_rows // BUCKET_ROWS))
    known = relation.sparkSession.sparkContext.broadcast(bitmap(maybe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def summed() -> pa.RecordBatch:
            words, counts = (np.concatenate(x) for x in zip(*held))
            keys = _key(words)
            order = np.argsort(keys)
            heads = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
            words, keys, total = words[order[heads]], keys[order[heads]], np.add.reduceat(counts[order], heads)
            # In a bucket sorted by words, first words are runs: their gaps are nearly all nothing.
            bucket = (keys % U64(buckets)).astype(np.int64)
            order = np.lexsort((*words.T[::-1], bucket))
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
            parts = [order[bounds[b] : bounds[b + 1]] for b in own]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([_planes(total[p].astype(U64)) for p in parts], pa.binary()), pa.array([[_planes(np.diff(words[p, j], prepend=U64(0))) for j in range(size)] for p in parts], pa.list_(pa.binary()))], schema=schema)

        for batch in batches:
            for row in zip(*batch.columns):
                phrases, _, pair = _pairs(row, k)
                own, count = _distinct(pair)
                words = _extended(phrases, own)
                may = in_bitmap(known.value, prints.of(_key(words))) if len(own) else np.zeros(0, bool)
                held.append((words[may], count[may]))
                n += int(may.sum())
                if n >= FLUSH_PRINTS:
                    yield summed()
                    held, n = [], 0
                    give_back()
        if n:
            yield summed()
        give_back()

    def total(group: pa.Table) -> pa.Table:
        columns = list(zip(*group.column("words").to_pylist()))
        w = np.column_stack([np.concatenate([np.cumsum(_from_planes(x), dtype=U64) for x in c]) for c in columns])
        counts = np.concatenate([_from_planes(x) for x in group.column("counts").to_pylist()]).astype(np.int64)
        keys = _key(w)
        own, first, _ = _counted(keys)
        _, sums = _summed(keys, counts)
        kept = sums >= least
        w, own, sums = w[first[kept]], own[kept], sums[kept]
        lists = {
            "words": [w[:, j] for j in range(size)],
            "firsts": [_key(w[:, :j]) for j in range(1, size)],
            "rests": [_key(w[:, j:]) for j in range(1, size)],
            "inside": [_key(w[:, i : i + m]) for m in range(2, size) for i in range(size - m + 1)],
        }
        made = {c: pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * len(x), np.column_stack(x).reshape(-1).view(np.int64)) if x else pa.array([[]] * len(w), pa.list_(pa.int64())) for c, x in lists.items()}
        give_back()
        return pa.table({"key": own.view(np.int64), "n": sums} | made)

    dealt = relation.select("phrases", "numbers", "follows").mapInArrow(run, "bucket int, counts binary, words array<binary>")
    return dealt.groupBy("bucket").applyInArrow(total, "key bigint, n bigint, words array<bigint>, firsts array<bigint>, rests array<bigint>, inside array<bigint>")


def extended(relation: DataFrame, k: int, frequent: DataFrame) -> DataFrame:
    """The occurrences of frequent phrases of k + 1 words, from those of k words: the merge-join again, semi-joined with what is frequent."""
    known = relation.sparkSession.sparkContext.broadcast(bitmap(frequent.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                phrases, at, pair = _pairs(row, k)
                own, _ = _distinct(pair)
                words = _extended(phrases, own)
                kept = in_bitmap(known.value, _key(words)) if len(own) else np.zeros(0, bool)
                number = np.searchsorted(own, pair)
                stays = kept[number]
                at = at[stays]
                yield _shard(words[kept], (np.cumsum(kept) - 1)[number[stays]], np.r_[False, at[1:] == at[:-1] + 1][: len(at)])
            give_back()

    return relation.select("phrases", "numbers", "follows").mapInArrow(run, RELATION)


def _scored(docs: DataFrame, max_words: int, least: int, inside_percent: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (key, lang, a, l, r, n, score); the keys of the words of each phrase (key, words); and the frequent words (key, word)."""
    spark, base, found = docs.sparkSession, f"{shared_dir(docs.sparkSession).rstrip('/')}/filingflow-occurrences-{uuid.uuid4().hex}", []
    atexit.register(removed, spark, base)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    # A word takes a separator, so half the bytes bound the words.
    most = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).first().n // 2 + 1
    prints = _prints(docs, most, least)
    relation = kept(occurrences(texts, prints, prints.frequent(word_prints(texts, prints))), "R1")
    frequent = kept(word_counts(relation, least), "words")
    totals = cut(relation.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n")))
    n_rows = frequent.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    known = frequent.select("key", "n", "lang")
    for k in range(1, max_words):
        prints = _prints(docs, n_rows, least)
        maybe = cut(prints.frequent(phrase_prints(relation, k, prints)))
        counts = kept(phrase_counts(relation, k, prints, maybe, n_rows, least), f"candidates{k + 1}")
        if k + 1 < max_words:
            relation = kept(extended(relation, k, counts), f"R{k + 1}")
            removed(spark, f"{base}/R{k}")
        found.append(counts.withColumnRenamed("n", "a"))
        known = known.unionByName(counts.select("key", "n", F.lit(None).cast("string").alias("lang")))
    removed(spark, f"{base}/R{max_words - 1}")
    candidates = found[0]
    for x in found[1:]:
        candidates = candidates.unionByName(x)
    cuts = candidates.select("key", "a", F.posexplode(F.arrays_zip("firsts", "rests")).alias("k", "c"))
    cuts = cuts.select("key", "a", "k", F.col("c.firsts").alias("first"), F.col("c.rests").alias("rest"))
    parts = cuts.join(known.select(F.col("key").alias("first"), F.col("n").alias("l"), "lang"), "first").join(known.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    parts = parts.withColumn("_aa", wide["a"] * wide["a"] * F.lit(1_000_000)).withColumn("_lr", wide["l"] * wide["r"])
    best = F.min(F.struct(F.expr("_aa div _lr").alias("score"), "k", "l", "r")).alias("best")
    scored = parts.groupBy("key").agg(F.max("lang").alias("lang"), F.first("a").alias("a"), best)
    longer = candidates.select(F.explode("inside").alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    whole = scored.join(longer, "key", "left").where(F.expr(f"longer IS NULL OR 100 * longer < {int(inside_percent)} * a"))
    rows = whole.join(totals, "lang").select("key", "lang", "a", "best.l", "best.r", "n", "best.score")
    return rows, candidates.select("key", "words"), frequent.select("key", "word")


def _spelled(scored: DataFrame, words: DataFrame, frequent: DataFrame) -> DataFrame:
    """Keys of words as strings: one row a word meets the frequent words, then the words of a phrase are put together again."""
    each = scored.select("key").join(words, "key").select("key", F.posexplode("words").alias("at", "word_key")).join(frequent.withColumnRenamed("key", "word_key"), "word_key")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return scored.join(each.groupBy("key").agg(phrase.alias("phrase")), "key").select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, inside_percent: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, phrase, a, l, r, n, score) of all phrases of 2 to max_words words that stand at least `least` times in their language.
    a, l, r: how often the phrase, its first and its second part stand there, at the cut with the lowest score floor(10**6 * a * a / (l *
    r)), the earliest of equals; n: words of the language. A phrase inside a longer one that stands at least inside_percent / 100 times as
    often is left out."""
    return _spelled(*_scored(docs, max_words, least, inside_percent, text_col, lang_col))


def top_collocations(docs: DataFrame, k: int = 2000, max_words: int = 3, least: int = 10, inside_percent: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first k collocations of each language by score, count and phrase, with their rank from 1."""
    scored, words, frequent = _scored(docs, max_words, least, inside_percent, text_col, lang_col)
    # Only what can be among the first k is spelled out; ties at the end are still all there.
    near = scored.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_rank") <= k).drop("_rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = _spelled(stored(near, "collocations"), words, frequent).withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
