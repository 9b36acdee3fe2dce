"""Language identification by interpolated Kneser-Ney character models, one a language.

Training counts the letter 4-grams of every labelled text (words in lower case, with a boundary sign before and after); Spark sums
the counts and derives from all of them, in joins, probabilities and back-off weights; lower orders count the distinct left neighbours
of a gram, as Kneser and Ney do. A model is a few sorted arrays of hashes, or beyond a stated size tables that texts are joined with;
the language with the lowest cross-entropy per sign wins. Two things are calibrated:
over all training rows, which cross-entropy is too high for a text of that length to be in the language at all (then the text is
rejected), and on a bounded sample of them, how sure a margin over the second language makes the choice.

A null text, or one without a letter, is 'und' with score 0. Without training rows every text is 'und'. Rows without a language
don't train. Repeated rows count as often as they stand. Ties go to the language first in order. Letters beyond the basic plane
count as one letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import LETTERS, U64, TextSlice, WordHasher, Words, cut, mixed, stored, text_slices

ORDER = 4
BOUNDARY = 32
UND = "und"


def distinct_words(s: TextSlice, words: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of the words numbered `of`: a number of each one's distinct form, how often each form stands, and the forms by line."""
    _, at, form, n = np.unique(words.hashes[of], return_index=True, return_inverse=True, return_counts=True)
    at = of[at]
    size = words.end[at] - words.start[at] + 1
    stop = np.cumsum(size)
    take = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(words.start[at], size)
    blob = s.data[np.minimum(take, len(s.data) - 1)]
    blob[stop - 1] = 10
    return form, n, blob.tobytes()


def letter_grams(lines: bytes) -> tuple[np.ndarray, np.ndarray]:
    """4-grams (16 bits a sign) of the words in each line, and the line of each: one for each letter and each end of a word."""
    code = np.frombuffer(lines.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32).astype(U64)
    line = np.cumsum(code == 10) - (code == 10)
    kinds, of = np.unique(code, return_inverse=True)
    letter = np.array([chr(int(c)).isalpha() for c in kinds], bool)[of]
    code = np.where(letter, np.minimum(code, U64(0xFFFF)), U64(BOUNDARY))
    back, seen = [], np.ones(len(code), bool)
    for j in (1, 2, 3):
        before, was = np.full(len(code), BOUNDARY, U64), np.zeros(len(code), bool)
        before[j:], was[j:] = code[:-j], letter[:-j]
        seen = seen & was
        back.append((np.where(seen, before, U64(BOUNDARY)), seen))
    told = letter | back[0][1]
    key = (back[2][0] << U64(48)) | (back[1][0] << U64(32)) | (back[0][0] << U64(16)) | code
    return key[told], line[told]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(n, heads) if len(heads) else n


def gram_counts(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, gram, n) over every labelled text; each task sums what it reads before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = WordHasher(*LETTERS), {}
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            codes, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
            for s in text_slices(batch.column(0)):
                words = hasher(s)
                of_word = np.repeat(codes[s.lo : s.hi], np.diff(words.first))
                for k in np.unique(of_word):
                    _, n, lines = distinct_words(s, words, np.flatnonzero(of_word == k))
                    keys, line = letter_grams(lines)
                    parts = held.setdefault(names[k], [])
                    parts.append(_summed(keys, n[line]))
                    if sum(len(x) for x, _ in parts) > 2_000_000:
                        held[names[k]] = [_summed(*map(np.concatenate, zip(*parts)))]
        for name, parts in held.items():
            keys, n = _summed(*map(np.concatenate, zip(*parts)))
            for lo in range(0, len(keys), 50_000):
                k = keys[lo : lo + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(n[lo : lo + 50_000].astype(np.int64))], ["lang", "gram", "n"])

    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _cut_to(signs: int) -> str:
    """SQL for the last signs of a gram."""
    return f"gram & {(1 << 16 * signs) - 1}" if signs < ORDER else "gram"


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (lang, gram, n) of all 4-grams: rows (lang, k, gram, p), the probabilities of the grams of orders k = 1 to 4, and
    rows (lang, k, gram, weight), the back-off weights of their contexts (of order 1: of the empty context 0). Orders below 4 count
    the distinct signs before a gram. The discount of a language and order is n1 / (n1 + 2 n2), and 1/2 where that can't be had."""
    grams, below = [counts.select("lang", "gram", "n")], None
    for k in range(ORDER - 1, 0, -1):
        grams.insert(0, cut(grams[0].groupBy("lang", F.expr(_cut_to(k)).alias("gram")).agg(F.count("*").alias("n"))))
    probabilities, weights = [], []
    for k, own in enumerate(grams, 1):
        once, twice = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
        discount = own.groupBy("lang").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("d"), F.count("*").alias("kinds"))
        own = own.withColumn("context", F.expr("shiftrightunsigned(gram, 16)") if k > 1 else F.lit(0).cast("bigint"))
        context = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("follow")).join(F.broadcast(discount), "lang").withColumn("weight", F.col("d") * F.col("follow") / F.col("total"))
        rows = own.join(context, ["lang", "context"])
        if below is None:
            rows = rows.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            rows = rows.withColumn("low", F.expr(_cut_to(k - 1))).join(below.select("lang", F.col("gram").alias("low"), F.col("p").alias("lower")), ["lang", "low"])
        below = cut(rows.select("lang", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("lower")).alias("p")))
        probabilities.append(below.select("lang", F.lit(k).alias("k"), "gram", "p"))
        weights.append(context.select("lang", F.lit(k).alias("k"), F.col("context").alias("gram"), "weight"))
    union = lambda parts: parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return cut(union(probabilities)), cut(union(weights))


def sorted_arrays(probabilities: DataFrame, weights: DataFrame) -> dict[str, list[tuple]]:
    """For each language and order: sorted hashes of grams, probabilities, sorted hashes of contexts, weights."""
    out: dict[str, list[list]] = {}
    for place, rows, value in ((0, probabilities.toArrow(), "p"), (2, weights.toArrow(), "weight")):
        lang, k = rows.column("lang").to_numpy(), rows.column("k").to_numpy()
        hashed, values = mixed(rows.column("gram").to_numpy().view(U64)), rows.column(value).to_numpy().astype(np.float32)
        for name in np.unique(lang) if len(lang) else ():
            for order in range(1, ORDER + 1):
                own = np.flatnonzero((lang == name) & (k == order))
                own = own[np.argsort(hashed[own])]
                out.setdefault(name, [[None] * 4 for _ in range(ORDER)])[order - 1][place : place + 2] = [hashed[own], values[own]]
    return {name: [tuple(x) for x in levels] for name, levels in out.items()}


def _find(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return k, hashes[k] == wanted


def log_probability(model: list[tuple], keys: np.ndarray) -> np.ndarray:
    """Log of the probability of each gram's last sign after those before it."""
    p = np.full(len(keys), float(model[0][3][0]) / (len(model[0][0]) + 1))
    for k, (grams, probability, contexts, weight) in enumerate(model, 1):
        own = keys & U64((1 << 16 * k) - 1) if k < ORDER else keys
        at, known = _find(grams, mixed(own))
        if k > 1:
            c, met = _find(contexts, mixed(own >> U64(16)))
            p = np.where(met, weight[c] * p, p)
        p = np.where(known, probability[at], p)
    return np.log(p)


class Calibration(NamedTuple):
    """limit[b]: the highest accepted cross-entropy of texts of 2**b to 2**(b+1) signs; sure: bias and slope over the log of the margin."""

    limit: np.ndarray
    bias: float
    slope: float


class Models(NamedTuple):
    """Models of languages: as sorted arrays where they are small enough to be broadcast, else as tables."""

    languages: list[str]
    arrays: list | None
    probabilities: DataFrame | None
    weights: DataFrame | None


class Identifier(NamedTuple):
    models: Models
    calibration: Calibration


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple]:
    """For each slice of texts in column `at`: batch, slice, distinct grams, and for each of its rows the signs; then for every
    (form of a word, gram) that occurs the numbers of both, and the row and form of each word."""
    hasher = WordHasher(*LETTERS)
    for batch in batches:
        for s in text_slices(batch.column(at)):
            words = hasher(s)
            form, _, lines = distinct_words(s, words, np.arange(len(words.hashes)))
            keys, line = letter_grams(lines)
            kinds, of = np.unique(keys, return_inverse=True)
            rows = np.repeat(np.arange(s.hi - s.lo), np.diff(words.first))
            signs = np.bincount(rows, np.bincount(line, minlength=lines.count(b"\n"))[form], s.hi - s.lo)
            yield batch, s, kinds, signs, line, of, rows, form


JUDGED = "signs bigint, best int, low double, margin double"


def judged(docs: DataFrame, models: Models, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, with the signs of its text, the number of the language of the lowest cross-entropy a sign (null
    without languages), this cross-entropy, and the log-likelihood ratio to the second, damped by the root of the signs, as signs of
    one text aren't independent."""
    if models.languages and models.arrays is None:
        return _judged_by_join(docs, models, keep, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(models.arrays or [])
    kept = docs.select(*keep)
    names = kept.columns
    # A text that is kept anyway isn't sent twice.
    rows = kept if text_col in names else docs.select(*keep, F.col(text_col).cast("string").alias(text_col))
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, s, kinds, signs, line, of, row, form in _slices(batches, at):
            n, forms = s.hi - s.lo, int(form.max()) + 1 if len(form) else 0
            best, low, margin = np.full(n, -1), np.zeros(n), np.zeros(n)
            if own:
                total = [np.bincount(row, np.bincount(line, log_probability(m, kinds)[of], forms)[form], n) for m in own]
                best, low, margin = _pick(-np.array(total).T / np.maximum(signs, 1)[:, None], signs)
            columns = [batch.column(i).slice(s.lo, n) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(signs.astype(np.int64)), pa.array(best.astype(np.int32), mask=best < 0), pa.array(low), pa.array(margin)], [*names, "signs", "best", "low", "margin"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.mapInArrow(run, f"{schema}, {JUDGED}")


def _judged_by_join(docs: DataFrame, models: Models, keep: list[Column], text_col: str) -> DataFrame:
    """judged() for models of any size: the distinct grams of all texts get their log probabilities by joins with the tables, and
    each row adds up those of its grams."""
    held = stored(docs.select(*keep, F.col(text_col).cast("string").alias("_text")).withColumn("_row", F.monotonically_increasing_id()), "texts")

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s, kinds, signs, line, of, row, form in _slices(batches, 0):
            # Grams of each word by its form, then of each row.
            order = np.argsort(line, kind="stable")
            first = np.searchsorted(line[order], np.arange(int(form.max()) + 2 if len(form) else 1))
            size = (first[1:] - first[:-1])[form]
            end = np.cumsum(size)
            take = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size) + np.repeat(first[:-1][form], size)
            pairs, n = np.unique(np.repeat(row, size) * len(kinds) + of[order][take], return_counts=True)
            ids = batch.column(1).slice(s.lo, s.hi - s.lo).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs // max(1, len(kinds))]), pa.array(kinds[pairs % max(1, len(kinds))].view(np.int64)), pa.array(n)], ["_row", "gram", "n"])

    rows = stored(held.select("_text", "_row").mapInArrow(grams_of, "_row bigint, gram bigint, n bigint"), "grams")
    unknown = models.weights.where("k = 1").select("lang", F.col("weight").alias("w1"))
    letters = models.probabilities.where("k = 1").groupBy("lang").agg(F.count("*").alias("letters"))
    told = rows.select("gram").distinct().withColumn("lang", F.explode(F.array(*map(F.lit, models.languages)))).join(F.broadcast(unknown.join(letters, "lang")), "lang").withColumn("p", F.col("w1") / (F.col("letters") + 1))
    for k in range(1, ORDER + 1):
        known = models.probabilities.where(F.col("k") == k).select("lang", F.col("gram").alias("own"), F.col("p").alias("q"))
        told = told.withColumn("own", F.expr(_cut_to(k)))
        if k > 1:
            met = models.weights.where(F.col("k") == k).select("lang", F.col("gram").alias("context"), "weight")
            told = told.withColumn("context", F.expr("shiftrightunsigned(own, 16)")).join(met, ["lang", "context"], "left").withColumn("p", F.coalesce("weight", F.lit(1.0)) * F.col("p")).drop("context", "weight")
        told = told.join(known, ["lang", "own"], "left").withColumn("p", F.coalesce("q", "p")).drop("own", "q")
    wide = told.groupBy("gram").agg(*(F.max(F.when(F.col("lang") == x, F.log("p"))).alias(f"l{k}") for k, x in enumerate(models.languages)))
    totals = rows.join(wide, "gram").groupBy("_row").agg(F.sum("n").alias("signs"), *(F.sum(F.col("n") * F.col(f"l{k}")).alias(f"l{k}") for k in range(len(models.languages))))
    each = F.array(*(F.struct((-F.col(f"l{k}") / F.col("signs")).alias("h"), F.lit(k).alias("k")) for k in range(len(models.languages))))
    ranked = totals.withColumn("r", F.array_sort(each))
    second = (F.col("r")[1]["h"] - F.col("r")[0]["h"]) * F.sqrt("signs") if len(models.languages) > 1 else F.sqrt("signs")
    picked = ranked.select("_row", "signs", F.col("r")[0]["k"].alias("best"), F.col("r")[0]["h"].alias("low"), second.alias("margin"))
    kept = [c for c in held.columns if c not in ("_text", "_row")]
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return held.drop("_text").join(picked, "_row", "left").select(*kept, F.coalesce("signs", F.lit(0)).cast("bigint").alias("signs"), F.coalesce("best", F.lit(0)).alias("best"), zero("low"), zero("margin"))


def _pick(entropy: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its cross-entropy, and the damped log-likelihood ratio to the second."""
    if entropy.shape[1] == 1:
        return np.zeros(len(entropy), np.int64), entropy[:, 0], np.sqrt(signs)
    best = entropy.argmin(1)
    two = np.partition(entropy, 1, axis=1)[:, :2]
    return best, two[:, 0], (two[:, 1] - two[:, 0]) * np.sqrt(signs)


def _length() -> Column:
    """The number of a text's limit: the whole logarithm of its signs."""
    return F.least(F.length(F.bin(F.greatest("signs", F.lit(1)))) - 1, F.lit(31)).cast("int")


def calibrated(highest: np.ndarray, margin: np.ndarray, right: np.ndarray, slack: float) -> Calibration:
    """highest[b]: the highest cross-entropy among all right choices of 2**b to 2**(b+1) signs. The limit of a length is the highest
    of that length or longer, plus slack nats a sign."""
    limit = np.maximum.accumulate(highest[::-1])[::-1]
    seen = np.isfinite(limit)
    limit[~seen] = limit[seen].max() if seen.any() else np.inf
    # Logistic regression of "right" on the log of the margin, by Newton steps of bounded length, with a weak pull to (0, 1).
    prior = np.array([0.0, 1.0])
    w, x, y = prior, np.c_[np.ones(len(margin)), np.log1p(margin)], right.astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - y) + (w - prior))
        w = w - step / max(1.0, float(np.abs(step).max()))
    return Calibration(limit + slack, float(w[0]), float(max(w[1], 1e-3)))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", broadcast_grams: int = 1 << 21, calibration_rows: int = 20_000, slack: float = 0.5) -> Identifier:
    """Learn from every labelled row; all grams count. Models of up to broadcast_grams grams of all orders together are sorted arrays
    that each task gets; larger ones stay tables, with the same results. calibration_rows bounds the sample (by hash of the id) that
    the two parameters of the scores are fitted on; limits of rejection come from every labelled row."""
    probabilities, weights = kneser_ney(cut(gram_counts(labelled, text_col, lang_col)))
    languages = sorted(r.lang for r in probabilities.select("lang").distinct().collect())
    if not languages:
        return Identifier(Models([], [], None, None), Calibration(np.full(32, np.inf), 0.0, 1.0))
    few = probabilities.limit(broadcast_grams + 1).count() <= broadcast_grams
    arrays = sorted_arrays(probabilities, weights) if few else {}
    models = Models(languages, [arrays[x] for x in languages] if few else None, probabilities, weights)
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isin(languages))
    truth = F.array_position(F.array(*map(F.lit, languages)), F.col("_lang")) - 1 == F.col("best")
    choices = judged(known, models, [F.xxhash64(id_col).alias("_h"), F.col(lang_col).cast("string").alias("_lang")], text_col).where("signs > 0")
    choices = cut(choices.select("_h", _length().alias("length"), "low", "margin", truth.alias("right")))
    top, n = np.full(32, -np.inf), 0
    for r in choices.groupBy("length").agg(F.max(F.when(F.col("right"), F.col("low"))).alias("low"), F.count("*").alias("n")).collect():
        n += r.n
        if r.low is not None:
            top[r.length] = r.low
    every = max(1, n // max(1, calibration_rows))
    seen = choices.where(F.pmod("_h", F.lit(every)) == 0).select("margin", "right").toArrow()
    return Identifier(models, calibrated(top, seen.column("margin").to_numpy(), seen.column("right").to_numpy(zero_copy_only=False), slack))


def identify(docs: DataFrame, model: Identifier, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, with lang_pred, score (how sure: 0 to 1) and rejected (no letters, or signs unlike any
    language that was learned)."""
    languages, (limit, bias, slope) = model.models.languages, model.calibration
    rows = judged(docs, model.models, keep, text_col)
    told = (F.col("signs") > 0) & F.col("best").isNotNull()
    sure = 1 / (1 + F.exp(-F.greatest(F.least(F.lit(bias) + F.lit(slope) * F.log1p("margin"), F.lit(30.0)), F.lit(-30.0))))
    limits = F.array(*(F.lit(float(x)) for x in limit))
    own = rows.columns[: -len(JUDGED.split(","))]
    return rows.select(
        *own, F.when(told, F.get(F.array(*map(F.lit, [*languages, UND])), F.col("best"))).otherwise(UND).alias("lang_pred"), F.when(told, sure).otherwise(0.0).alias("score"), F.coalesce(~told | (F.col("low") > F.get(limits, _length())), F.lit(True)).alias("rejected")
    )
