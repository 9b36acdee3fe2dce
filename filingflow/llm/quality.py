"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of 50 words). Each passage is described by a few statistics of its signs and words and by the
shares of its words in hash classes, and encoded by a small network; gated attention, learned from document labels alone, weighs the passages, and the weighted representation gives
the score. The network learns on a bounded sample of labelled documents, of which very long ones give evenly spread passages; every
text of the table is scored, in whole.

A null, empty or wordless text is a bag of one passage whose statistics are all zero. Labels other than 0 and 1 don't train. A
document with several labels is taken with each of them. Without training rows, or with one class only, the score is the share of 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import SPACED_FOLDED, U64, TextSlice, WordHasher, text_slices

PASSAGE_WORDS = 50
#: Hash classes of words.
WORD_CLASSES = 32
N_FEATURES = 22 + WORD_CLASSES
HIDDEN, ATTENTION = 16, 8


def byte_classes() -> np.ndarray:
    """0 lower-case letter, 1 capital, 2 digit, 3 beyond ASCII, 4 end of sentence or comma, 5 bar, 6 other sign, 7 line end, 8 other space or control."""
    out = np.full(256, 6)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 3
    out[[ord(c) for c in ".,;:?"]] = 4
    out[ord("|")] = 5
    out[:33] = 8
    out[10] = 7
    return out


def passages(hasher: WordHasher, s: TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of each passage of a slice, and the row of each passage; each row has one at least."""
    words = hasher(s)
    n = np.diff(words.first)
    per_row = np.maximum(-(-n // PASSAGE_WORDS), 1)
    rows = np.repeat(np.arange(len(n)), per_row)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    lo = words.first[:-1][rows] + k * PASSAGE_WORDS
    hi = np.minimum(lo + PASSAGE_WORDS, words.first[1:][rows])
    out = np.zeros((len(rows), N_FEATURES))
    if not len(words.hashes):
        return out, rows
    full = np.flatnonzero(hi > lo)
    lo, hi = lo[full], hi[full]
    count = (hi - lo).astype(float)
    a, b = words.start[lo], words.end[hi - 1]
    size = np.maximum(b - a, 1).astype(float)
    kinds = byte_classes().astype(np.uint8)[s.data]
    for c in range(9):
        total = np.zeros(len(kinds) + 1, np.int32)
        np.cumsum(kinds == c, out=total[1:])
        out[full, c] = (total[b] - total[a]) / size
    of = np.repeat(np.arange(len(lo)), hi - lo)
    per = lambda x: np.bincount(of, x, len(lo)) / count
    length = (words.end - words.start).astype(float)
    first, last = kinds[words.start], kinds[words.end - 1]
    order = np.lexsort((words.hashes, of))
    h, o = words.hashes[order], of[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
    runs = np.flatnonzero(new)
    most = np.zeros(len(lo))
    np.maximum.at(most, o[runs], np.diff(np.r_[runs, len(o)]))
    same = np.r_[False, words.hashes[1:] == words.hashes[:-1]]
    columns = [per(length) / 10, np.sqrt(np.maximum(per(length**2) - per(length) ** 2, 0)) / 10, per(length <= 3), per(length >= 12), per(first == 1), per(last == 6), per(last == 4), np.bincount(o, new, len(lo)) / count, most / count, per(same), count / PASSAGE_WORDS, np.log1p(n[rows[full]]) / 12, np.ones(len(lo))]
    for j, x in enumerate(columns, 9):
        out[full, j] = x
    classes = np.bincount(of * WORD_CLASSES + (words.hashes % U64(WORD_CLASSES)).astype(np.int64), minlength=len(lo) * WORD_CLASSES)
    out[full, 22:] = classes.reshape(-1, WORD_CLASSES) / count[:, None]
    return out, rows


class Network:
    """Encoder, gated attention and output of a bag, with gradients written out."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    @staticmethod
    def new(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        shape = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        return Network([shape(N_FEATURES, HIDDEN), np.zeros(HIDDEN), shape(HIDDEN, ATTENTION), shape(HIDDEN, ATTENTION), shape(ATTENTION, 1)[:, 0], shape(HIDDEN, 1)[:, 0], np.zeros(1)])

    def forward(self, x: np.ndarray, bag: np.ndarray, n_bags: int) -> tuple:
        w, b, v, u, a, out, bias = self.parts
        h = np.tanh(x @ w + b)
        tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = np.exp(np.clip((tv * su) @ a, -20, 20))
        weight = e / np.bincount(bag, e, n_bags)[bag]
        z = np.zeros((n_bags, HIDDEN))
        for j in range(HIDDEN):
            z[:, j] = np.bincount(bag, weight * h[:, j], n_bags)
        return 1 / (1 + np.exp(-np.clip(z @ out + bias[0], -30, 30))), h, tv, su, weight, z

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, v, u, a, out, bias = self.parts
        p, h, tv, su, weight, z = self.forward(x, bag, len(y))
        d = (p - y) / len(y)
        dz = d[:, None] * out[None, :]
        dh = weight[:, None] * dz[bag]
        dot = (h * dz[bag]).sum(1)
        de = weight * (dot - np.bincount(bag, weight * dot, len(y))[bag])
        dg = de[:, None] * a[None, :]
        dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
        dh += dv @ v.T + du @ u.T
        dx = dh * (1 - h**2)
        return [x.T @ dx, dx.sum(0), h.T @ dv, h.T @ du, (tv * su).T @ de, z.T @ d, np.array([d.sum()])]


def train(x: np.ndarray, bag: np.ndarray, y: np.ndarray, steps: int = 600, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam over batches of bags, with a decaying rate; bags are numbered 0, 1, ... in order."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    first, second = [[np.zeros_like(p) for p in net.parts] for _ in range(2)]
    at = np.searchsorted(bag, np.arange(len(y) + 1))
    order = np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < min(batch, len(y)):
            order = rng.permutation(len(y))
        own, order = order[:batch], order[batch:]
        take = np.concatenate([np.arange(at[k], at[k + 1]) for k in own])
        grads = net.gradients(x[take], np.repeat(np.arange(len(own)), np.diff(at)[own]), y[own])
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.parts[k] = net.parts[k] - rate * (1 - t / steps * 0.95) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return net


def _described(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple]:
    hasher = WordHasher(*SPACED_FOLDED)
    for batch in batches:
        for s in text_slices(batch.column(text)):
            yield batch, s, *passages(hasher, s)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 8192, sample_passages: int = 64) -> tuple:
    """Learn from rows with id, text and label. sample_docs bounds the documents (first by hash of the id) that train, and
    sample_passages the passages that each of these trains with, so that what the driver learns from has a stated size."""
    chosen = labelled.where(F.col(label_col).isin(0, 1)).withColumn("_h", F.xxhash64(F.lit(17), id_col))
    total = chosen.agg(F.count("*").alias("n"), F.avg(label_col).alias("share")).first()
    # About sample_docs rows by a hash threshold, so that texts of others are not moved.
    kept = chosen.where(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(1, total.n))))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s, x, rows in _described(batches, 1):
            first = np.searchsorted(rows, np.arange(s.hi - s.lo + 1))
            of, n = np.arange(len(rows)) - first[rows], np.diff(first)[rows]
            # Evenly spread: passages at which the share of the bag passes a whole number of its sample_passages parts.
            own = (n <= sample_passages) | ((of + 1) * sample_passages // n > of * sample_passages // n)
            x, rows = x[own], rows[own]
            at = np.searchsorted(rows, np.arange(s.hi - s.lo + 1)) * N_FEATURES
            values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), values, batch.column(2).slice(s.lo, s.hi - s.lo)], ["h", "x", "y"])

    rows = kept.select("_h", F.col(text_col).cast("string"), F.col(label_col).cast("int")).mapInArrow(describe, "h bigint, x array<float>, y int").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    y = rows.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None, None, None, float(total.share if total.share is not None else 0.5)
    x = rows.column("x").combine_chunks()
    sizes = np.asarray(x.value_lengths()) // N_FEATURES
    values = np.asarray(x.flatten()).reshape(-1, N_FEATURES).astype(float)
    mean, spread = values.mean(0), values.std(0) + 1e-6
    net = train((values - mean) / spread, np.repeat(np.arange(len(y)), sizes), y)
    return net.parts, mean, spread, float(y.mean())


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, n_passages, top_passage): top_passage is the number of the passage with the highest weight, from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, mean, spread, share = shared.value
        for batch, s, x, rows in _described(batches, 1):
            n = s.hi - s.lo
            first = np.searchsorted(rows, np.arange(n))
            if parts is None:
                p, top = np.full(n, share), np.zeros(n, np.int64)
            else:
                p, _, _, _, weight, _ = Network(parts).forward((x - mean) / spread, rows, n)
                order = np.lexsort((-np.arange(len(rows)), weight, rows))
                top = order[np.r_[np.searchsorted(rows, np.arange(1, n)), len(rows)] - 1] - first
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, n), pa.array(p), pa.array(np.bincount(rows, minlength=n)), pa.array(top)], ["doc_id", "score", "n_passages", "top_passage"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, score double, n_passages bigint, top_passage bigint")
