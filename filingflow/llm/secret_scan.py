"""Secret scans: an Aho-Corasick automaton finds keywords in one pass, anchored expressions run only where a keyword stands, and
formats that carry a checksum or a structure of their own must pass it.

Kinds: assign, access and hex are plain; github and npm tokens carry a CRC-32, jwt a JSON header, pem a closing line. The run of hex
digits has no keyword of its own: the automaton reads the text a second time with every hex digit folded to one sign, and its
keyword is a run of 32 such signs.

A null or empty text has no span. Spans count code points, the end is exclusive; spans of one kind never overlap. Repeated rows each
give their own row; other columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.llm.common import text_slices

KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "pem"]
# Keywords of each kind, in lower case for assign, and the expressions that start at a keyword.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
PREFIXES = {"AKIA": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyJ": "jwt", "-----BEGIN ": "pem"}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]*)\.(eyJ[A-Za-z0-9_-]*)\.[A-Za-z0-9_-]*")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END \1PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = 32


def checksum62(payload: str) -> str:
    """CRC-32 of a token's payload in base 62, six digits."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out


def _is_json(text: str, start: int, end: int) -> bool:
    """Whether a part of a text is the base64 of a JSON object. What is no UTF-8 at its beginning needs no look at the rest."""
    try:
        head = text[start : min(end, start + 64)]
        codecs.getincrementaldecoder("utf-8")().decode(base64.urlsafe_b64decode(head[: len(head) // 4 * 4]))
        return isinstance(json.loads(base64.urlsafe_b64decode(text[start:end] + "=" * ((start - end) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


class Scanner:
    """Both automata; built once a task."""

    def __init__(self):
        self.words, self.exact = ahocorasick.Automaton(), ahocorasick.Automaton()
        for w in ASSIGN_WORDS:
            self.words.add_word(w, len(w))
        for w, kind in PREFIXES.items():
            self.exact.add_word(w, (len(w), kind))
        self.words.make_automaton()
        self.exact.make_automaton()
        self.fold = bytes(HEX if chr(b) in "0123456789abcdef" else OTHER for b in range(256))
        self.run = ahocorasick.Automaton()
        self.run.add_word(chr(HEX) * HEX_RUN, None)
        self.run.make_automaton()

    def hex_runs(self, text: str) -> list[tuple[int, int]]:
        """Maximal runs of at least 32 hex digits."""
        folded = text.encode("latin-1", "replace").translate(self.fold).decode("latin-1")
        out = []
        if chr(HEX) * HEX_RUN in folded:
            for end, _ in self.run.iter(folded):
                if out and end == out[-1][1]:
                    out[-1] = (out[-1][0], end + 1)
                else:
                    out.append((end + 1 - HEX_RUN, end + 1))
        return out

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """Spans (start, number of the kind, end) in order."""
        found = []
        last = 0
        lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        for start in sorted(end + 1 - size for end, size in self.words.iter(lower)):
            if start >= last and (m := ASSIGN.match(text, start)):
                last = m.end()
                if m.end(2) - m.start(2) >= 8:
                    found.append((start, "assign", last))
        ends, header, token = dict.fromkeys(KINDS, 0), 0, 0
        for end, (size, kind) in self.exact.iter(text):
            start = end + 1 - size
            if start < ends[kind]:
                continue
            if kind == "access":
                if m := ACCESS.match(text, start):
                    ends[kind] = m.end()
                    if m.end() - start >= 16:
                        found.append((start, kind, m.end()))
                continue
            if kind == "jwt":
                if start >= header:
                    # Every beginning on one run of signs is followed by the same parts.
                    m = JWT.match(text, start)
                    header, token = (m.end(1), m.end()) if m else (JWT_RUN.match(text, start).end(), 0)
                if token and _is_json(text, start, header):
                    ends[kind] = token
                    found.append((start, kind, token))
                continue
            m = (PEM if kind == "pem" else CHECKED).match(text, start)
            if m and (kind == "pem" or checksum62(m[1]) == m[2]):
                ends[kind] = m.end()
                found.append((start, kind, m.end()))
        found += [(a, "hex", b) for a, b in self.hex_runs(text)]
        return sorted((a, KINDS.index(kind), b) for a, kind, b in found)


HEX, OTHER = ord("h"), ord(".")
SPANS = "spans array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, the text with each secret replaced by [SECRET] (null stays null), and all spans."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = rows.drop("_text")
    names, n = kept.columns, len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for s in text_slices(batch.column(n)):
                part = batch.slice(s.lo, s.hi - s.lo)
                clean, spans = [], []
                for text in part.column(n).to_pylist():
                    own = scanner(text) if text else []
                    spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own])
                    clean.append(redacted(text, own))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(clean, pa.string()), pa.array(spans, span)], [*names, "_clean", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", _clean string, " + SPANS
    return rows.mapInArrow(run, schema)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """Spans may overlap; their union is replaced."""
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def joined_spans(col: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def n_of(col: str, kind: str) -> Column:
    return F.size(F.filter(col, lambda s: s["kind"] == kind)).cast("bigint")


def scan_report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the three plain kinds, a digest of their spans, and all spans, for every row."""
    found = scan(docs, [F.col(id_col).alias("doc_id")])
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))
    counts = [n_of("spans", k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))
