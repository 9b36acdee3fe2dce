"""Personal data by weak supervision.

Wide patterns propose spans. Three labelers vote on each, for, against or not at all: its shape (a strict form of its kind and what
touches it), a gazetteer (names and words that are no names, domains, number ranges) and its context (cue words around it for and
against). Expectation-maximisation over the counts of vote patterns, taken over all documents, estimates for each kind how often each
labeler gives each vote on true and on false spans, and so how likely each pattern is personal data; a logistic span classifier then
learns these probabilities from votes and features of a bounded sample of spans. Strict e-mail addresses, IP addresses, card numbers
and international phone numbers always stay; other spans stay if the classifier says so.

A null or empty text has no span. Spans count code points, the end is exclusive; spans of one kind never overlap. Repeated rows each
give their own row. Without any candidate nothing is learned and nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import stored, text_slices

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "local_phone", "hidden_email", "ssn", "person"]
LABELERS = ["shape", "gazetteer", "context"]

# Gazetteers and cue words of the labelers. First names are a parameter; these are the default.
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "nl", "eu", "info", "biz", "us", "ca", "au", "jp", "in", "br", "mx", "ch", "at", "be", "id", "sg"}
FIRST_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen christopher nancy daniel lisa matthew betty anthony "
    "margaret mark sandra donald ashley steven kimberly paul emily andrew donna joshua michelle kenneth carol kevin amanda brian melissa george deborah edward stephanie ronald rebecca timothy laura "
    "hans peter klaus anna maria wolfgang sabine monika heike jürgen petra stefan andrea dieter ursula jean pierre marie claude michel sophie françois nathalie philippe isabelle jose juan luis carmen "
    "ana carlos antonio manuel pilar javier lucia miguel elena rosa fernando".split()
)
NO_NAMES = {"street", "road", "avenue", "lane", "square", "park", "land", "city", "county", "river", "lake", "mount", "island", "university", "college", "school", "institute", "hospital", "church", "bank", "inc", "ltd", "corp", "company", "group", "foundation", "prize", "award", "act", "day", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "the", "and", "of", "in"}
MAIL = r"e-?mail|mail|contact|write|reach|courriel|correo|schreib"
CALL = r"phone|tel\b|tel[.:]|call|mobile|fax|contact|handy|t[eé]l[eé]phone|llam|ruf"
CUES = {"email": MAIL, "hidden_email": MAIL, "ip": r"\bip\b|host|server|address|login|adresse|direcci", "card": r"card|visa|master|credit|payment|carte|tarjeta|karte|iban", "phone": CALL, "local_phone": CALL, "ssn": r"\bssn\b|social|security|insurance|taxpayer", "person": r"\bmrs?\b|\bms\b|\bdr\b|\bprof\b|name|dear|herr|frau|monsieur|madame|se[ñn]or|signed|contact|born|author|regards|sincerely"}
NUMBERED = r"order|part|invoice|serial|sku|\bref\b|reference|isbn|model|ticket|case|item|catalog|batch|tracking|product|\bno[.:]|number of"
COUNTER_CUES = {"email": r"package|version|commit", "hidden_email": r"package|version", "ip": r"version|release|section|chapter|build|\bv$|clause", "card": NUMBERED, "phone": NUMBERED, "local_phone": NUMBERED, "ssn": NUMBERED, "person": r"\b(?:in|at|near|on|to|from|the|of)\x20$"}
CONTEXT = 40
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")
HIDDEN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\[dot\]|\(dot\))\x20?|\.)[A-Za-z0-9-]{1,63})+")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
CAPITAL = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
TITLE = re.compile(rf"\b(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?)\.?\x20({CAPITAL}(?:\x20{CAPITAL})?)")
STRANGER = re.compile(rf"(?:\bname\x20is|\bsigned,?|\bregards,?|\bsincerely,?)\s({CAPITAL}\x20{CAPITAL})")


@lru_cache
def known_names(names: frozenset) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(sorted(x.capitalize() for x in names)) + rf")\x20{CAPITAL}")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from each @ outwards."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def candidates(text: str, names: frozenset = FIRST_NAMES) -> list[tuple[int, str, int, bool]]:
    """(start, kind, end, base) of all proposed spans; base spans are the strict ones."""
    out = [(a, "email", b, True) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), "ip", m.end(), True) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            d = digits(m[0]) if m.end() - m.start() <= 40 else ""
            if 14 <= len(d) <= 19:
                out.append((m.start(), "card", m.end(), luhn(d)))
        if "+" in text:
            out += [(m.start(), "phone", m.end(), True) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
        if "-" in text or "." in text:
            out += [(m.start(), "local_phone", m.end(), False) for m in LOCAL_PHONE.finditer(text)]
            out += [(m.start(), "ssn", m.end(), False) for m in SSN.finditer(text)]
    if "[at]" in text or "(at)" in text:
        out += [(m.start(), "hidden_email", m.end(), False) for m in HIDDEN_EMAIL.finditer(text)]
    people = sorted({m.span() for m in known_names(names).finditer(text)} | {m.span(1) for p in (TITLE, STRANGER) for m in p.finditer(text)}, key=lambda x: (x[0], -x[1]))
    last = 0
    for a, b in people:
        if a >= last:
            out.append((a, "person", b, False))
            last = b
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def shape_vote(text: str, start: int, kind: str, end: int, base: bool) -> int:
    """Whether the span has the strict form of its kind, and stands on its own. What every proposed span has is no vote."""
    span, before, after = text[start:end], text[max(0, start - 1) : start], text[end : end + 1]
    apart = not before.isalnum() and not after.isalnum()
    if kind == "email":
        name, _, domain = span.partition("@")
        return 1 if apart and name.strip("0123456789._%+-") and domain.rsplit(".", 1)[-1].isalpha() else -1
    if kind == "ip":
        return 1 if apart and before != "." and after != "." and not any(len(x) > 1 and x[0] == "0" for x in span.split(".")) else -1
    if kind == "card":
        return 1 if base and apart else -1
    if kind == "phone":
        return 1 if 10 <= len(digits(span)) <= 13 and span.count("(") == span.count(")") else -1
    if kind == "hidden_email":
        return 1 if "dot" in span else 0
    if kind == "person":
        longer = re.match(rf"\x20{CAPITAL}", text[end : end + 40]) or re.search(rf"{CAPITAL}\x20$", text[max(0, start - 40) : start])
        return -1 if longer else 0
    return -1 if not apart or before in ("-", "#", "/") or after in ("-", "/") else 1 if span[0] == "(" else 0


def gazetteer_vote(span: str, kind: str, names: frozenset) -> int:
    """Whether known names, domains or number ranges know the span; a range that most numbers are in is no vote for it."""
    d = digits(span)
    if kind in ("email", "hidden_email"):
        return 1 if span.rsplit(".", 1)[-1].rstrip(")]").lower() in TOP_DOMAINS else 0 if kind == "hidden_email" else -1
    if kind == "ip":
        first = int(span.split(".")[0])
        return -1 if first in (0, 127) or first >= 224 or span.endswith(".0") else 1
    if kind == "card":
        return 1 if d[:1] in "4562" or d[:2] in ("34", "37", "30", "36", "38") else -1
    if kind == "ssn":
        return -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 0
    if kind == "local_phone":
        return 0 if d[0] in "23456789" and d[3] in "23456789" and len(set(d)) > 2 else -1
    if kind == "phone":
        return -1 if d.startswith("0") or len(set(d)) < 3 else 0
    own = [w.lower() for w in span.split(" ")]
    return -1 if any(w in NO_NAMES for w in own) else 1 if own[0] in names else 0


def context_vote(text: str, start: int, kind: str, end: int) -> int:
    """Cue words just before the span or, for a person's kind of place, just after; those against count more, as they are narrower."""
    before = text[max(0, start - CONTEXT) : start]
    near = re.split(r"[.!?\n]\s", before)[-1] if kind == "person" else before
    if re.search(COUNTER_CUES[kind], near, re.IGNORECASE):
        return -1
    if kind == "person" and (m := re.match(r"\x20([A-Za-z]+)", text[end : end + 20])) and m[1].lower() in NO_NAMES and m[1][0].isupper():
        return -1
    return 1 if re.search(CUES[kind], before, re.IGNORECASE) else 0


def votes(text: str, start: int, kind: str, end: int, base: bool, names: frozenset = FIRST_NAMES) -> str:
    """A sign for each of LABELERS: + for, - against, 0 no opinion."""
    cast = shape_vote(text, start, kind, end, base), gazetteer_vote(text[start:end], kind, names), context_vote(text, start, kind, end)
    return "".join("0+-"[v] for v in cast)


def measures(text: str, start: int, end: int) -> list[float]:
    """Length, share of digits, whether the span stands at a line's edge."""
    return [min(end - start, 40) / 40, len(digits(text[start:end])) / (end - start), float(not start or text[start - 1] == "\n" or end == len(text) or text[end] == "\n")]


SPAN = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:string,f:array<float>>>"


def proposed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: frozenset = FIRST_NAMES) -> DataFrame:
    """Rows (doc_id, spans): the proposed spans of every row with votes and measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("f", pa.list_(pa.float32()))]))
        for batch in batches:
            for s in text_slices(batch.column(1)):
                part, out = batch.slice(s.lo, s.hi - s.lo), []
                for text in part.column(1).to_pylist():
                    out.append([{"kind": k, "start": a, "end": b, "base": base, "votes": votes(text, a, k, b, base, names), "f": measures(text, a, b)} for a, k, b, base in candidates(text, names)] if text else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id bigint, spans {SPAN}")


#: What a labeler is taken to do before anything is seen: votes (0, +, -) on true and on false spans, as counts, and how many spans of a
#: hundred it weighs as much as. It decides where counts alone can't, as when only one labeler ever varies.
PRIOR, PRIOR_SHARE = np.array([[3.0, 6.0, 1.0], [3.0, 1.0, 6.0]]), 0.005


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 100) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count): the probability that each pattern is personal data, and for each kind how
    often each labeler gives each vote (0, +, -) on true and on false spans. Labelers are taken as independent given the truth; one
    that votes alike on both tells nothing. The share of true spans is held between a quarter and three quarters, so that both sorts
    are told apart where only one labeler ever varies, instead of all spans being of one sort."""
    truth, seen = {}, {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        cast = np.array([["0+-".index(c) for c in v] for v, _ in own])
        n = np.array([n for _, n in own], float)
        prior = PRIOR * max(1.0, PRIOR_SHARE * n.sum() / PRIOR.sum(1)[0] * 10)
        share, table = 0.5, np.repeat((PRIOR / PRIOR.sum(1, keepdims=True))[None], len(LABELERS), 0)
        for _ in range(rounds):
            like = np.log([share, 1 - share]) + sum(np.log(table[j][:, cast[:, j]]).T for j in range(len(LABELERS)))
            p = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -30, 30)))
            weight = np.stack([p * n, (1 - p) * n])
            table = np.stack([np.stack([np.bincount(cast[:, j], w, 3) for w in weight]) + prior for j in range(len(LABELERS))])
            table /= table.sum(2, keepdims=True)
            share = float((weight[0].sum() + n.sum() / 2) / (2 * n.sum()))
        truth |= {(kind, v): float(x) for (v, _), x in zip(own, p)}
        seen[kind] = table
    return truth, seen


def features(kind: str, v: str) -> list[float]:
    """Bias, kinds, votes for and against, and votes of each kind."""
    cast = [("0+-".index(c) + 1) % 3 - 1 for c in v]
    return [1.0, *(float(kind == k) for k in KINDS), *(float(c == s) for c in v for s in "+-"), *(c * float(kind == k) for k in KINDS for c in cast)]


def span_classifier(rows: list, truth: dict, rounds: int = 30) -> np.ndarray:
    """Logistic regression of the estimated probabilities on features and measures, by Newton's method with a weak pull to zero."""
    x = np.array([[*features(r.kind, r.votes), *r.f] for r in rows])
    y = np.array([truth[r.kind, r.votes] for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
    return w


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_spans: int = 20_000, names: frozenset = FIRST_NAMES) -> DataFrame:
    """Rows (doc_id, spans) with spans (kind, start, end, base, p) that stay: the base spans and those of at least even chance.
    sample_spans bounds the spans (first by hash of their place) that the classifier learns from."""
    held = stored(proposed(docs, id_col, text_col, names), "spans")
    each = held.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    counts = each.groupBy("kind", "votes").count().collect()
    odds = lambda s: F.lit(0.0)
    if counts:
        truth, _ = reliabilities([(r.kind, r.votes, r["count"]) for r in counts])
        rows = each.select("kind", "votes", "f", F.xxhash64("doc_id", "kind", "start").alias("h")).orderBy("h").limit(sample_spans).collect()
        w = span_classifier(rows, truth)
        # One entry a kind and pattern of votes: at most 27 times the kinds.
        by_pattern = F.create_map(*(F.lit(x) for r in counts for x in (r.kind + r.votes, float(w[:-3] @ features(r.kind, r.votes)))))
        odds = lambda s: by_pattern[F.concat(s["kind"], s["votes"])] + sum(s["f"][j] * F.lit(float(w[j - 3])) for j in range(3))
    scored = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), (1 / (1 + F.exp(-odds(s)))).alias("p")))
    return held.select("doc_id", F.filter(scored, lambda s: s["base"] | (s["p"] >= 0.5)).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def find_report(docs: DataFrame) -> DataFrame:
    """Counts of the four base kinds, a digest of their spans, and all spans that stay, for every row."""
    found = find(docs).withColumn("strict", F.filter("spans", lambda s: s["base"]))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("strict", _is(k))).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("strict"), 256).alias("base_sha256"), joined("spans").alias("spans"))
