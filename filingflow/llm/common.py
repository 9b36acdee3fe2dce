"""What the operators share: scratch tables in the cluster's shared folder, and words of whole texts as hashed numpy arrays."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer text is one step of its own.
SLICE_BYTES = 1 << 18
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is set (tests, one machine)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; Spark's cleaner removes its files when the frame is no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: for tables of which later steps read only some columns. The folder is
    removed when the program ends."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/filingflow-{name}-{uuid.uuid4().hex}"
    atexit.register(removed, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, through Spark's own file systems. Without a running session nothing is done."""
    if spark.sparkContext._jsc is None:
        return
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def give_back() -> None:
    """Workers are used again by other tasks: what Arrow and the C library hold back of freed memory would add up."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class TextSlice(NamedTuple):
    """Rows lo..hi of an Arrow batch: the UTF-8 bytes of their texts, and where each begins (one more than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[TextSlice]:
    """A text column in slices of about max_bytes, each row whole. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, raw_at, raw = column.buffers()
    at = np.frombuffer(raw_at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + max_bytes, "right")) - 1)
        yield TextSlice(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi
    give_back()


class Alphabet(NamedTuple):
    """Which bytes are word bytes, and the number that each byte stands for in hashes (equal numbers: bytes held equal)."""

    is_word: np.ndarray
    number: np.ndarray


def _byte_numbers() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def alphabet(separators: bytes, fold_ascii_case: bool) -> Alphabet:
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    fold = np.arange(256)
    if fold_ascii_case:
        fold[65:91] += 32
    return Alphabet(is_word, _byte_numbers()[fold])


#: [^\x20\x09-\x0D]+, with and without A-Z folded; [0-9a-z and all beyond ASCII]+ with A-Z folded; letters and all beyond ASCII.
SPACE = bytes([32, *range(9, 14)])
SPACED_FOLDED = (SPACE, True)
SPACED = (SPACE, False)
ALNUM = (bytes(b for b in range(128) if not chr(b).isalnum()), True)
LETTERS = (bytes(b for b in range(128) if not chr(b).isalpha()), False)

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xC2B2AE3D27D4EB4F


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """Words of a slice in order: 64-bit hashes, byte spans; words first[d]..first[d+1] are those of row d."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


class WordHasher:
    """Splits slices into words and hashes each by a polynomial over its bytes, all in numpy."""

    def __init__(self, separators: bytes, fold_ascii_case: bool):
        self.alphabet = alphabet(separators, fold_ascii_case)
        self.up = self.down = np.ones(1, U64)

    def __call__(self, s: TextSlice) -> Words:
        n = len(s.data)
        if not n:
            return Words(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(s.at), np.int64))
        if len(self.up) < n + 1:
            self.up, self.down = powers(_P, n + 1), powers(_P_INV, n + 1)
        inside = self.alphabet.is_word[s.data]
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        begins = s.at[:-1][s.at[:-1] < n]
        before[begins] = False
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        after[begins[begins > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        total = np.zeros(n + 1, U64)
        np.cumsum(self.alphabet.number[s.data] * self.up[:n], out=total[1:])
        hashes = mixed((total[end] - total[start]) * self.down[start] + (end - start).astype(U64) * U64(_Q))
        return Words(hashes, start, end, np.searchsorted(start, s.at))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive numbers: len - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k <= 8:
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= U64(_Q)
            out += hashes[j : n + j]
        return mixed(out)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(_P, len(hashes)), out=total[1:])
    return mixed((total[k:] - total[:-k]) * powers(_P_INV, n))


def within_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of k words: the starts that stay in one row, and the row of each."""
    sizes = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    starts = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + first[:-1][rows]
    return starts, rows


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Entries that a task gathers before it sends them off in packed rows.
FLUSH_ENTRIES = 500_000


class Buckets:
    """Columns of entries gathered and then dealt out to buckets by a hash, as one packed row a bucket."""

    def __init__(self, buckets: int, columns: dict):
        self.buckets, self.columns, self.held, self.n = buckets, columns, [], 0

    def add(self, *columns: np.ndarray) -> bool:
        self.held.append(columns)
        self.n += len(columns[0])
        return self.n >= FLUSH_ENTRIES

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        columns = [np.concatenate(x) for x in zip(*self.held)]
        bucket = (mixed(columns[0]) % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        own = [k for k in range(self.buckets) if bounds[k] < bounds[k + 1]]
        out = {"bucket": pa.array(own, pa.int32())}
        for (name, kind), x in zip(self.columns.items(), columns):
            x = x[order].astype(kind)
            out[name] = pa.array([packed(x[bounds[k] : bounds[k + 1]]) for k in own], pa.binary())
        self.held, self.n = [], 0
        yield pa.RecordBatch.from_pydict(out)


def unpacked(table: pa.Table, columns: dict) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in columns.items()]


def bucket_schema(columns: dict) -> str:
    return "bucket int, " + ", ".join(f"{c} binary" for c in columns)


def dealt_out(columns: dict, buckets: int, *values: np.ndarray) -> pa.Table:
    """Columns as packed rows by a hash of the first."""
    out = Buckets(buckets, columns)
    out.add(*values)
    schema = pa.schema([("bucket", pa.int32()), *((name, pa.binary()) for name in columns)])
    return pa.Table.from_batches(out.flush(), schema)


#: A filter over ids or class keys has 16 bits a key, up to 2**26 (8 MB): what isn't in it needs no shuffle; beyond, more rows are moved.
KEY_BITS, MOST_BITS = 16, 26


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of a column `key`; its size follows the rows up to a limit."""
    bits = min(MOST_BITS, max(10, (KEY_BITS * keys.count()).bit_length()))
    slot = f"pmod(key, {1 << bits})"
    words = keys.groupBy(F.expr(f"shiftright({slot}, 5)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({slot}, 32) as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key, whether it may be one of the bitmap's."""
    slot = (keys.view(U64) % U64(len(bits) * 32)).astype(np.int64)
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 > 0


#: Rows that a task hands back at once.
ROWS_BACK = 500


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame, broadcast_ids: int = 1 << 20) -> DataFrame:
    """docs without the rows whose id is in gone (one column; a null there takes rows without id). Up to broadcast_ids ids are
    broadcast; of more, only rows that a bitmap of the ids lets through are moved to be joined. The other rows stay where they are."""
    gone = cut(gone.select(gone[gone.columns[0]].cast("bigint").alias("_gone")).distinct())
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_gone"))
    if gone.limit(broadcast_ids + 1).count() <= broadcast_ids:
        return docs.join(F.broadcast(gone), same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(F.coalesce("_gone", F.lit(0)).alias("key"))))
    at = docs.columns.index(id_col)

    def only(suspects: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                keep = in_bitmap(shared.value, ids) == suspects
                for lo in range(0, batch.num_rows, ROWS_BACK):
                    if keep[lo : lo + ROWS_BACK].any():
                        yield batch.slice(lo, ROWS_BACK).filter(pa.array(keep[lo : lo + ROWS_BACK]))
                give_back()

        return docs.mapInArrow(run, docs.schema)

    moved = only(True).join(gone, same, "left_anti")
    return only(False).unionByName(moved)


def clashing(each: DataFrame) -> list[int]:
    """Class keys that two different contents share, by a second hash in the column `other`. Of n contents n * n / 2**65 are expected:
    some hundred of 10**11."""
    return [r.key for r in each.groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a != b").select("key").collect()]
