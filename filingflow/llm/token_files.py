"""Token ids as grammar-compressed binary files.

`encode` orders documents by id (nulls first; rows that share an id by a hash of the text, then by place), turns whole texts into ids
with the tokenizers library, ends each document with the end id, and packs about SHARD_IDS ids of whole documents into one shard. A
shard is compressed by Re-Pair: frequent pairs of neighbouring symbols are replaced by new symbols, again and again, never across the
end of a document. `write` stores the shards as Parquet; `read_documents`, `read_ranges` and `report` work from the files alone.

Layout of a shard (little-endian): header (magic, first new symbol, symbol width, number of documents, symbols, rules), ids of all
earlier documents of the shard (uint64, one more than documents), where each document's symbols begin (uint32, one more), left and
right of each rule (uint32), ids that each rule stands for (uint32), symbols (uint16 if all fit, else uint32). A document's symbols are
its own, so a range of a document is found by the running sum of the lengths of its symbols, and only symbols that reach into the
range are expanded.

Nulls count as empty texts: only the end id. Repeated rows are each written. An empty table gives no shard. Texts of any length are
encoded whole; a document of more than SHARD_IDS ids is a shard of its own.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filingflow.llm.common import give_back, shared_dir, text_slices

#: Ids of a shard, about.
SHARD_IDS = 1 << 19
#: Text that is cut into pieces at once.
PIECE_BYTES = 1 << 22
#: Known pieces of a worker; beyond, it begins anew.
MOST_PIECES = 1 << 20
#: Letters below this code point are letters by any version of Unicode.
_PLAIN_LETTERS = 0x250
#: A pair is replaced if it stands this often in a shard; at most so many rounds, and none that saves less than this share.
LEAST_PAIRS, ROUNDS, LEAST_SAVED = 16, 8, 0.02
#: Odd numbers that deal pairs out to slots, another one as the sequence gets shorter.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
HEADER = "<4sIIQQQ"
MAGIC = b"FRP1"
SHARDS = "part int, shard int, before bigint, n_ids bigint, doc_ids array<bigint>, body binary"

# Kinds of bytes. Between two ASCII bytes of different kinds the tokenizer's own splitting rule always cuts; at an apostrophe, in runs of
# white space and among letters beyond ASCII we leave the decision to the library.
_LETTER, _DIGIT, _MARK, _OTHER = 1, 2, 3, 0
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[39] = _OTHER
#: Bytes that are no white space: printable ASCII, and those that begin U+00C0 to U+023F.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = _SOLID[0xC3:0xC9] = True
_BREAK = np.zeros(256, bool)
_BREAK[9:14] = True


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places inside the bytes of texts (each begins at one of `at`) where a byte-level tokenizer's splitting rule is sure to cut: before a
    space that no white space follows, before and after a line end that stands alone, and where letters, digits and marks of ASCII meet."""
    kind, solid, breaks = _KIND[data], _SOLID[data], _BREAK[data]
    printable = solid & (data < 128)
    sure = np.zeros(len(data), bool)
    sure[:-1] = (data[:-1] == 32) & solid[1:]
    sure[at[(at > 0) & (at < len(data))] - 1] = False
    sure[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    sure[1:] |= breaks[1:] & printable[:-1]
    sure[2:] |= printable[:-2] & breaks[1:-1] & solid[2:]
    return np.flatnonzero(sure)


class PieceEncoder:
    """Encodes texts piece by piece and remembers the ids of pieces, since most pieces come again. The ids are those of whole texts as
    long as the tokenizer splits by the byte-level rule and changes nothing before; for any other tokenizer texts are encoded whole."""

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        rule = str(self.tokenizer.pre_tokenizer)
        self.by_pieces = rule.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in rule and self.tokenizer.normalizer is None
        self.model, self.letter_bytes = self.tokenizer.model, {}
        for c in map(chr, range(_PLAIN_LETTERS)):
            if c.isalpha():
                self.letter_bytes.update(zip(c.encode(), self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] if self.by_pieces else ""))
        self.forget()

    def __reduce__(self):
        # Sent as a path. A broadcast encoder is made once in each Python worker and keeps what it knows from task to task.
        return PieceEncoder, (self.path,)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces. A run of letters, with a space before it or not, is one piece of the splitting rule too: the library's model can
        take it without splitting it again, byte by byte as the rule writes them (the space as U+0120)."""
        out: list = [None] * len(pieces)
        rest = []
        for k, p in enumerate(pieces):
            word = p[1:] if p[0] == " " else p
            if word.isalpha() and (word.isascii() or ord(max(word)) < _PLAIN_LETTERS):
                plain = word if word.isascii() else "".join(map(self.letter_bytes.__getitem__, word.encode()))
                out[k] = [t.id for t in self.model.tokenize("\u0120" + plain if len(word) < len(p) else plain)]
            else:
                rest.append(k)
        for k, ids in zip(rest, self._ids([pieces[k] for k in rest])):
            out[k] = ids
        return out

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of pieces; new ones are encoded."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > MOST_PIECES:
            self.forget()
            new = pieces
        for p in new:
            self.known[p] = len(self.known)
        if new:
            ids = self._piece_ids(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            total, first = self.used + int(sizes.sum()), len(self.known) - len(new)
            if total > len(self.flat):
                self.flat = np.r_[self.flat[: self.used], np.zeros(2 * total - self.used, np.uint32)]
            if len(self.known) + 1 > len(self.at):
                self.at = np.r_[self.at[: first + 1], np.zeros(2 * len(self.known), np.int64)]
            self.flat[self.used : total] = np.fromiter((x for e in ids for x in e), np.uint32, total - self.used)
            self.at[first + 1 : len(self.known) + 1] = self.used + np.cumsum(sizes)
            self.used = total
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts at[0]..at[1], at[1]..at[2], ... of the bytes, and how many each has."""
        if not self.by_pieces:
            ids = self._ids([data[lo:hi].tobytes().decode() for lo, hi in zip(at[:-1], at[1:])])
            return np.fromiter((x for e in ids for x in e), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        inside = np.zeros(len(data) + 1, bool)
        inside[cuts(data, at)] = True
        inside[at] = True
        ends = np.flatnonzero(inside)
        pieces = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        number = self._numbers(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        sizes = self.at[number + 1] - self.at[number]
        return _taken(self.flat, self.at[number], sizes), np.add.reduceat(np.r_[sizes, 0], np.searchsorted(ends, at[:-1])) * (np.diff(at) > 0)


def _taken(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[0] : start[0] + size[0]], flat[start[1] : ...], ... one after the other."""
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]


class Grammar(NamedTuple):
    """Symbols of documents (document d has symbols first[d]..first[d+1]), and the rules: symbol base + k stands for left[k], right[k]."""

    base: int
    symbols: np.ndarray
    first: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _ranked(pair: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs by (count falling, pair); the places of their occurrences and the rank of each. Pairs are counted in a
    table of slots: a slot counts one pair exactly, the one that wrote last, which a rare pair seldom is; what a pair loses there it can
    get back in the next round, when slots are dealt out anew."""
    bits = max(8, min(22, len(pair).bit_length()))
    slot = ((pair.view(np.uint64) * np.uint64(_ODD[len(pair) % len(_ODD)])) >> np.uint64(64 - bits)).astype(np.int32)
    owner = np.empty(1 << bits, np.int64)
    owner[slot] = pair
    own = owner[slot] == pair
    count = np.bincount(slot[own], minlength=1 << bits)
    often = np.flatnonzero(count >= LEAST_PAIRS)
    often = often[np.lexsort((owner[often], -count[often]))[:most]]
    rank = np.full(1 << bits, -1, np.int32)
    rank[often] = np.arange(len(often))
    found = rank[slot]
    at = np.flatnonzero(own & (found >= 0))
    return owner[often], place[at], found[at]


def compress(ids: np.ndarray, first: np.ndarray, base: int, most_rules: int | None = None) -> Grammar:
    """Re-Pair in rounds: each counts all pairs of neighbours and replaces the frequent ones. Where two frequent pairs overlap, the one
    with the higher count is replaced, in a run of one symbol every other one. A pair that is left with one place keeps its symbols.
    most_rules: by default as many as keep symbols in 16 bits, or 2**20 where ids need more anyway."""
    most = most_rules if most_rules is not None else (1 << 16) - base if base < 1 << 16 else 1 << 20
    seq, first = ids.astype(np.int64), first.astype(np.int64)
    left, right = [], []
    made = 0
    for _ in range(ROUNDS):
        if len(seq) < 2 or made >= most:
            break
        inside = np.ones(len(seq), bool)
        inside[first[1:] - 1] = False
        place = np.flatnonzero(inside)
        pairs, at, rank = _ranked((seq[place] << 32) | seq[place + 1], place, most - made)
        if not len(pairs):
            break
        # Of neighbours that overlap the better rank wins; a run of one pair is taken at every other place.
        joined = np.r_[False, at[1:] == at[:-1] + 1]
        same = joined & np.r_[False, rank[1:] == rank[:-1]]
        run = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        even = (np.arange(len(at)) - run) % 2 == 0
        worse = np.r_[False, rank[1:] > rank[:-1]] & joined
        better_next = np.r_[rank[1:] < rank[:-1], False] & np.r_[joined[1:], False]
        chosen = ~worse & ~better_next & even
        uses = np.bincount(rank[chosen], minlength=len(pairs))
        kept = uses >= 2
        chosen &= kept[rank]
        if chosen.sum() < LEAST_SAVED * len(seq):
            break
        left.append(pairs[kept] >> 32)
        right.append(pairs[kept] & 0xFFFFFFFF)
        at = at[chosen]
        seq[at] = base + made + (np.cumsum(kept) - 1)[rank[chosen]]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        first = first - np.searchsorted(at + 1, first)
        seq = seq[stay]
        made += int(kept.sum())
    join = lambda x: np.concatenate(x).astype(np.uint32) if x else np.zeros(0, np.uint32)
    return Grammar(base, seq.astype(np.uint32), first, join(left), join(right))


def _expansions(base: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that each rule stands for, one after the other, and where each begins."""
    flat, size = np.stack([left, right], 1).reshape(-1), np.full(len(left), 2, np.int64)
    while (big := flat >= base).any():
        width = 1 + big
        at = np.cumsum(width) - width
        out = np.repeat(flat, width)
        rule = flat[big] - base
        out[at[big]], out[at[big] + 1] = left[rule], right[rule]
        size = np.add.reduceat(width, np.cumsum(size) - size)
        flat = out
    return flat, np.r_[0, np.cumsum(size)]


def packed_shard(ids: np.ndarray, first: np.ndarray, base: int) -> bytes:
    g = compress(ids, first, base)
    _, at = _expansions(base, g.left, g.right)
    width = 2 if base + len(g.left) <= 1 << 16 else 4
    parts = [struct.pack(HEADER, MAGIC, base, width, len(first) - 1, len(g.symbols), len(g.left)), first.astype("<u8"), g.first.astype("<u4"), g.left.astype("<u4"), g.right.astype("<u4"), np.diff(at).astype("<u4"), g.symbols.astype(f"<u{width}")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Shard:
    """A shard's arrays, without copies; `ids` expands only what is asked for."""

    def __init__(self, body: bytes):
        magic, self.base, width, docs, symbols, rules = struct.unpack_from(HEADER, body)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEADER)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        self.first, self.symbol_at = take("<u8", docs + 1).astype(np.int64), take("<u4", docs + 1).astype(np.int64)
        self.left, self.right, self.length = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)
        self._flat = None

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        if self._flat is None:
            flat, at = _expansions(self.base, self.left, self.right)
            # Ids first, then the expansions of rules.
            self._flat, self._at = np.r_[np.arange(self.base, dtype=np.uint32), flat.astype(np.uint32)], at
        small = symbols < self.base
        rule = np.where(small, 0, symbols.astype(np.int64) - self.base)
        start = np.where(small, symbols, self.base + self._at[rule] if len(self.left) else 0)
        return _taken(self._flat, start.astype(np.int64), np.where(small, 1, self.length[rule] if len(self.left) else 1).astype(np.int64))

    def all_ids(self) -> np.ndarray:
        return self._expanded(self.symbols)

    def ids(self, doc: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo..hi of a document of the shard, at random access: only symbols that reach into the range are expanded."""
        n = int(self.first[doc + 1] - self.first[doc])
        lo, hi = max(0, lo), n if hi is None else min(hi, n)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        own = self.symbols[self.symbol_at[doc] : self.symbol_at[doc + 1]]
        big = own >= self.base
        size = np.ones(len(own), np.int64)
        size[big] = self.length[own[big].astype(np.int64) - self.base]
        end = np.cumsum(size)
        a, b = int(np.searchsorted(end, lo, "right")), int(np.searchsorted(end, hi, "left")) + 1
        return self._expanded(own[a:b])[lo - (end[a] - size[a]) :][: hi - lo]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Rows of shards in ascending order of id over (part, shard). before: ids of the part's earlier shards."""

    shared = docs.sparkSession.sparkContext.broadcast(PieceEncoder(tokenizer))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared.value, TaskContext.get().partitionId()
        base = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        ids, sizes, names, held, number, before = [], [], [], 0, 0, 0

        def packed() -> pa.RecordBatch:
            first = np.r_[0, np.cumsum(sizes)].astype(np.int64)
            row = [part, number, before, int(first[-1]), names, packed_shard(np.concatenate(ids), first, base)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["part", "shard", "before", "n_ids", "doc_ids", "body"])

        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for s in text_slices(batch.column(1), PIECE_BYTES):
                own, counts = encoder(s.data, s.at)
                ends = np.cumsum(counts)
                own = np.insert(own, ends, end_id)
                counts = counts + 1
                ends = ends + np.arange(1, len(counts) + 1)
                doc_ids, lo = batch.column(0).slice(s.lo, s.hi - s.lo).to_pylist(), 0
                while lo < len(counts):
                    # Documents up to the one that fills the shard.
                    done = int(ends[lo - 1]) if lo else 0
                    hi = min(len(counts), int(np.searchsorted(ends, done + SHARD_IDS - held)) + 1)
                    ids.append(own[done : ends[hi - 1]])
                    sizes.extend(counts[lo:hi].tolist())
                    names.extend(doc_ids[lo:hi])
                    held += int(ends[hi - 1]) - done
                    if held >= SHARD_IDS:
                        yield packed()
                        ids, sizes, names, number, before, held = [], [], [], number + 1, before + held, 0
                    lo = hi
        if sizes:
            yield packed()
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.select("id", "text", order[1].alias("_hash"), order[2].alias("_place"))
    placed = rows.repartitionByRange("id", "_hash", "_place").sortWithinPartitions("id", "_hash", "_place")
    return placed.select("id", "text").mapInArrow(shards, SHARDS)


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode documents and store their shards under a path of the shared store."""
    encode(docs, tokenizer, id_col, text_col, end_id).write.parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/filingflow-tokens-{uuid.uuid4().hex}"


def _starts(files: DataFrame) -> DataFrame:
    """Rows (part, part_start): ids of all earlier parts. One row a part, so the window stays as small as the number of tasks."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def report(files: DataFrame) -> DataFrame:
    """One row a document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens (with the end id),
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, names, body in zip(*batch.columns):
                s = Shard(body.as_buffer())
                raw = memoryview(np.ascontiguousarray(s.all_ids().astype("<u4"))).cast("B")
                at = s.first * 4
                crc = [zlib.crc32(raw[lo:hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
                columns = {"part": pa.array([part.as_py()] * len(crc), pa.int32()), "doc_id": names.values, "local": pa.array(before.as_py() + s.first[:-1]), "n_tokens": pa.array(np.diff(s.first)), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)
            give_back()

    rows = files.select("part", "before", "doc_ids", "body").mapInArrow(run, "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(_starts(files), "part").select("doc_id", (F.col("part_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(files: DataFrame) -> DataFrame:
    """Rows (doc_id, ids) of whole documents, end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, body in zip(*batch.columns):
                s = Shard(body.as_buffer())
                yield pa.RecordBatch.from_arrays([names.values, pa.LargeListArray.from_arrays(s.first, pa.array(s.all_ids().astype(np.int64))).cast(pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files.select("doc_ids", "body").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def read_ranges(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """For wanted rows (doc_id, lo, hi) the ids lo..hi of the document, as (doc_id, lo, hi, ids): ranges meet their shards by a join on
    ids of documents, and of a shard only the asked symbols are expanded. A range outside a document gives what lies inside; an unknown
    document gives no row, a repeated one a row each."""
    places = files.select("part", "shard", F.posexplode("doc_ids").alias("row", "doc_id"))
    asked = wanted.select("doc_id", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi")).join(places, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, s, out = None, None, []
            for body, row, lo, hi in zip(batch.column("body"), batch.column("row").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
                if last is None or body != last:
                    last, s = body, Shard(body.as_buffer())
                out.append(s.ids(row, lo, hi).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lo"), batch.column("hi"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "lo", "hi", "ids"])

    return asked.join(files.select("part", "shard", "body"), ["part", "shard"]).select("doc_id", "lo", "hi", "row", "body").mapInArrow(run, "doc_id bigint, lo bigint, hi bigint, ids array<bigint>")
