"""Records of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that are records, and elements whose content is no markup.
RECORD_TAGS = {"article", "tr", "p", "li", "script", "h1", "h2", "h3", "h4", "h5", "h6"}
RAW_TAGS = {"script", "style"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-z][a-z0-9]*)(?:[^>"']|"[^"]*"|'[^']*')*+>""", re.S | re.I)


def outermost(html: str) -> list[tuple[int, int, str]]:
    """First sign, end and name of each record element that stands in no other one. An element that never ends is no record, nor is
    what follows it."""
    out, at, name, depth, begin = [], 0, None, 0, 0
    while m := TAG.search(html, at):
        at, tag, closes = m.end(), (m[2] or "").lower(), bool(m[1])
        if tag in RAW_TAGS and not closes:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            if end and name is None and tag in RECORD_TAGS:
                out.append((m.start(), at, tag))
        elif m[0].endswith("/>"):
            if name is None and tag in RECORD_TAGS:
                out.append((m.start(), at, tag))
        elif name is None:
            if tag in RECORD_TAGS and not closes:
                name, depth, begin = tag, 1, m.start()
        elif tag == name:
            depth += -1 if closes else 1
            if not depth:
                out.append((begin, at, name))
                name = None
    return out


def html_records(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Rows (id, ordinal, offset, tag, content) of each page; a null or empty page has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, k, a, tag, html[a:b]) for key, html in frame.itertuples(index=False) if html for k, (a, b, tag) in enumerate(outermost(html))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "offset", "tag", "content"])

    return pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).cast("string")).mapInPandas(run, "id bigint, ordinal bigint, offset bigint, tag string, content string")
