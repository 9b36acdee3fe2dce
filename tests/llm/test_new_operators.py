"""Token files, ranked search and collocations against brute force and round trips, with nulls, ties, repeats and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filingflow.llm import collocations, queries, ranked_search, token_files
from filingflow.llm.common import table

DOCS = "doc_id bigint, text string, lang string, part string, term string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def texts(rng):
    """Nulls, empty and short texts, repeats, odd white space, marks, letters beyond ASCII and one very long text."""
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 120))) for _ in range(15)]
    odd = [None, "", " \n\t ", "one", "Don't  stop, it's 3.14!\n\nNow.", "  two  spaces ", "tail \n", "\n\nhead", "x" * 3000, "aaaa " * 200, "ñandú éé ü　b ​z 日本 😀", "<|endoftext|> as text", "a,b;c: d-e_f\tg\x0bh\x0ci\rj"]
    return [*odd, *base, base[0], base[0], base[1].upper(), " ".join(rng.choice(WORDS) for _ in range(20_000))]


def frame(spark, rows):
    """Rows (doc_id, text, lang) with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, lang, "p", "t") for i, t, lang in rows], DOCS)


def test_pieces_are_encoded_as_whole_texts():
    encoder, rng = token_files.PieceEncoder(TOKENIZER), random.Random(5)
    letters = list("aZ é19.,'\n\t\r   　́ñ日x\x1c\x85​²st😀")
    many = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["foo  ", "x", "", " bar", "b \n", "\nc"]
    data = [t.encode() for t in many]
    at = np.r_[0, np.cumsum([len(d) for d in data])]
    ids, sizes = encoder(np.frombuffer(b"".join(data), np.uint8), at)
    first = np.r_[0, np.cumsum(sizes)]
    for k, t in enumerate(many):
        assert ids[first[k] : first[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("base,most", [(300, None), (70_000, None), (300, 3), (300, 0)])
def test_grammar_round_trip(base, most):
    rng = np.random.default_rng(2)
    runs = [np.zeros(0, np.int64), np.full(501, 7), np.full(64, 0), np.tile([1, 2, 3], 200), rng.integers(0, 6, 5000), rng.zipf(1.3, 20_000) % base, np.array([base - 1])]
    ids, first = np.concatenate(runs).astype(np.uint32), np.r_[0, np.cumsum([len(r) for r in runs])]
    g = token_files.compress(ids, first, base, most)
    flat, at = token_files._expansions(base, g.left, g.right)
    assert all((flat < base)) and len(at) == len(g.left) + 1
    # Each rule stands for its two sides, made of earlier symbols, and is used at least twice.
    assert all(x < base + k and y < base + k for k, (x, y) in enumerate(zip(g.left.tolist(), g.right.tolist())))
    used = Counter(g.symbols.tolist()) + Counter(g.left.tolist()) + Counter(g.right.tolist())
    assert all(used[base + k] >= 2 for k in range(len(g.left)))
    s = token_files.Shard(token_files.packed_shard(ids, first, base))
    assert s.all_ids().tolist() == ids.tolist()
    assert most is not None or len(g.symbols) < 0.9 * len(ids)
    for d, r in enumerate(runs):
        assert s.ids(d).tolist() == r.tolist()
        for lo, hi in ((0, 1), (3, 17), (len(r) - 2, len(r) + 5), (5, 5), (-3, 2)):
            assert s.ids(d, lo, hi).tolist() == r[max(0, lo) : max(0, hi)].tolist()


@pytest.mark.parametrize("shard_ids", [token_files.SHARD_IDS, 500])
def test_token_files(spark, tmp_path, shard_ids, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", shard_ids)
    rng = random.Random(3)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    rows += [(None, "without id"), (7, "same id again"), (7, "same id again")]
    path = str(tmp_path / "ids")
    token_files.write(frame(spark, [(i, t, "en") for i, t in rows]).repartition(5), path, TOKENIZER)
    files = spark.read.parquet(path)
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    got = sorted(token_files.report(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.elements())
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert Counter((r.doc_id, tuple(r.ids)) for r in token_files.read_documents(files).collect()) == want
    whole = {i: x for i, x in want if i is not None and i != 7}
    asked = [(i, lo, lo + 9) for i in list(whole)[:20] for lo in (0, 4, 10_000)] + [(99_999, 0, 5)]
    found = token_files.read_ranges(files, spark.createDataFrame(asked, "doc_id bigint, lo int, hi int")).collect()
    assert len(found) == len(asked) - 1 and all(tuple(r.ids) == whole[r.doc_id][r.lo : r.hi] for r in found)
    empty = str(tmp_path / "none")
    token_files.write(frame(spark, []), empty, TOKENIZER)
    assert token_files.report(spark.read.schema(token_files.SHARDS).parquet(empty)).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def ranking(rows, items, k):
    """All items against all documents, each score by the rule."""
    terms = [Counter(TERM.findall(folded(t))) for _, t in rows]
    lengths = [sum(c.values()) for c in terms]
    n_docs, n_words = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(x for c in terms for x in c)
    out = []
    for item, text in items:
        scores = defaultdict(int)
        for x, times in Counter(TERM.findall(folded(text))).items():
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
            for d, c in enumerate(terms):
                if c[x]:
                    m = 100 - 25 + 25 * lengths[d] * n_docs // n_words
                    scores[d] += times * w * (1_000_000_000 * c[x] // (1000 * c[x] + 12 * m))
        best = sorted((-s, rows[d][0] is None, rows[d][0] or 0) for d, s in scores.items() if s > 0)[:k]
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("shard,block,items_at_once,k", [(1 << 24, 64, 2048, 20), (3000, 4, 3, 5), (1, 2, 1, 3)])
def test_ranked_search_matches_brute_force(spark, shard, block, items_at_once, k, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard)
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", items_at_once)
    rng = random.Random(4)
    many = texts(rng) + [" ".join(rng.choice(WORDS[: rng.randint(2, 17)]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [*enumerate(many), (None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta")]
    items = [(1, "alpha"), (2, "Alpha alpha BETA"), (2, "zeta eta"), (3, None), (4, "unknown words"), (5, ""), (None, " ".join(WORDS)), (6, many[14]), (7, "ñandú日本 3 14")]
    if shard == 1:
        rows, items = rows[:60], items[:4]
    d = frame(spark, [(i, t, "en") for i, t in rows]).repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, score int")
    got = ranked_search.search(ranked_search.build_index(d), q, k).collect()
    assert Counter(tuple(r) for r in got) == ranking(rows, items, k)


def test_non_essential_blocks_stay_packed(spark, monkeypatch):
    """Of a frequent term's list, only blocks with candidates of the rare term are unpacked, and the results are those of brute force."""
    monkeypatch.setattr(ranked_search, "BLOCK", 8)
    rows = [(i, "common " * (1 + i % 3) + "filler " * (i % 7) + ("rare rare" if i % 500 == 3 else "")) for i in range(3000)]
    row = ranked_search.build_index(frame(spark, [(i, t, "en") for i, t in rows]).coalesce(1)).toArrow().to_batches()[0]
    words = ranked_search._item_terms(spark.createDataFrame([(1, "rare common")], "item_id bigint, text string"), "item_id", "text").first().words
    vocabulary, df = np.unique(np.frombuffer(words, np.uint64)), []
    terms = np.frombuffer(row.column("terms")[0].as_py(), np.uint64)
    df = np.frombuffer(row.column("df")[0].as_py(), np.uint32)[np.searchsorted(terms, vocabulary)].astype(np.int64)
    rule, n = ranked_search.Ranking(), (3000, int(row.column("n_words")[0].as_py()))
    items = ranked_search._Items(vocabulary, rule.weights(df, n[0]), *n, np.array([0, 2]), np.array([0, 1]), np.array([1, 1]))
    s = ranked_search._Shard({c: row.column(i)[0] for i, c in enumerate(row.schema.names)}, items, rule)
    unpacked, blocks = [], s.blocks
    s.blocks = lambda which: unpacked.extend(which.tolist()) or blocks(which)
    docs, scores = s.best(0, 5, int(s.list_bound.min()) + 1)
    assert len(unpacked) < 20 < len(s.bound)
    best = sorted(zip((-scores).tolist(), docs.tolist()))[:5]
    assert Counter((1, k + 1, d, -x) for k, (x, d) in enumerate(best)) == ranking(rows, [(1, "rare common")], 5)


def test_ranked_search_of_nothing(spark):
    d, q = frame(spark, [(1, "alpha", "en"), (2, None, "en")]), spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    assert ranked_search.search_documents(d.limit(0), q).count() == 0
    assert ranked_search.search_documents(d.where("doc_id = 2"), q).count() == 0
    assert ranked_search.search_documents(d, q.limit(0)).count() == 0
    assert [tuple(r) for r in ranked_search.search_documents(d, q).collect()] == next(iter([list(ranking([(1, "alpha")], [(1, "alpha")], 20))]))


def mined(rows, longest, least, percent):
    """Phrases by counting all of them."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", folded(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for key, a in f.items():
        lang, w = key[0], key[1:]
        if len(w) < 2 or a < least:
            continue
        longer = [b for other, b in f.items() if other[0] == lang and len(other) > len(key) and b >= least and any(other[i : i + len(w)] == w for i in range(1, len(other) - len(w) + 1))]
        if any(100 * b >= percent * a for b in longer):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, *w[:j]] * f[lang, *w[j:]]), j, f[lang, *w[:j]], f[lang, *w[j:]]) for j in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, total[lang], score))
    return out


@pytest.mark.parametrize("longest,least,slices", [(3, 10, None), (4, 3, 64), (2, 2, 1)])
def test_collocations_match_brute_force(spark, longest, least, slices, monkeypatch):
    if slices:
        monkeypatch.setattr(collocations, "SHARD_BYTES", slices)
        monkeypatch.setattr(collocations, "BUCKET_ROWS", 50)
    rng = random.Random(6)
    many = texts(rng)[: -1 if longest == 4 else None] + [rng.choice(["Deep learning model", "deep. learning model", "New York, new york", "x x x x", "ñ é ü"]) + " " + rng.choice(WORDS) for _ in range(120)]
    rows = [(t, rng.choice(["en", "en", "de", None, "", "und"])) for t in many]
    d = frame(spark, [(i, t, lang) for i, (t, lang) in enumerate(rows)]).repartition(3)
    got = [tuple(r) for r in collocations.collocations(d, longest, least).collect()]
    want = mined(rows, longest, least, 50)
    assert Counter(got) == Counter(want) and len(got) > 20
    top = [tuple(r) for r in collocations.top_collocations(d, 7, longest, least).collect()]
    ranked = []
    for lang in {r[0] for r in want}:
        own = sorted((r for r in want if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:7]
        ranked += [(r[0], k + 1, *r[1:]) for k, r in enumerate(own)]
    assert Counter(top) == Counter(ranked)


def test_collocations_of_nothing(spark):
    d = frame(spark, [(1, None, None), (2, "", "en"), (3, "only once", "en")])
    assert collocations.top_collocations(d).count() == 0
    assert collocations.top_collocations(d.limit(0)).count() == 0


def test_registered_token_files(spark, sf):
    library = Tokenizer.from_file(TOKENIZER)
    docs = sorted(table(spark, sf, "documents").select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    got = sorted(queries.op11_token_files(spark, sf).collect(), key=lambda r: r.start)
    at = 0
    for r, g in zip(docs, got, strict=True):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert tuple(g) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert table(spark, sf, "documents").where(F.col("text").isNull()).count() >= 0
