"""Partitions, contexts, parts and mentions on small documents, by hand and against plain Python."""

import random
import re

from pyspark.sql import functions as F

from filingflow.operators import mentions, sections

CODES = ["ABCD", "WIKA", "WEGE", "WTON", "GRPM", "NAIK", "KBLI", "BBB8"]


def codes(spark):
    return spark.createDataFrame([(c,) for c in CODES], "code string")


MD = """# Daily report

First paragraph
goes on.


  Second, after two blank lines.

| date | code |
|---|---|
| 2026-01-02 | ABCD |
| 2026-01-03 | WIKA GOLD |
## 1. ABCD — PT Abcd Tbk
text of abcd
### WIKA inside ABCD
- item
## Other
- one
- two
```
- code, no item
```
### WEGE
mine
#### deeper
yours
### Plain
back
# WTON
last"""


def test_markdown_partition(spark):
    long_list = "\n\n## Long\n\n" + "".join(f"- item {k} ABCD {'x' * 60}\n  more\n" for k in range(20)) + "```\n- fenced\n" + "y" * 100 + "\n```\n- after\n~~~\n- open fence\n"
    docs = spark.createDataFrame([("a", "md", MD), ("b", "md", MD + long_list), ("c", "md", ""), ("d", "md", None), ("e", "md", "no heading | at all")], "doc string, kind string, text string")
    rows = sections.partition_documents(docs, codes(spark)).orderBy("doc", "ordinal").collect()
    text = {r.doc: r.text for r in docs.collect()}
    for doc in "abe":
        own = [r for r in rows if r.doc == doc]
        assert "".join(r.content for r in own) == text[doc]
        for r in own:
            assert text[doc][r.start : r.end] == r.content and r.line == text[doc][: r.start].count("\n") + 1
    assert not [r for r in rows if r.doc in "cd"]
    a = [(r.kind, r.content) for r in rows if r.doc == "a"]
    assert [c for k, c in a if k == "issuer_section"] == ["## 1. ABCD — PT Abcd Tbk\ntext of abcd\n### WIKA inside ABCD\n- item\n", "### WEGE\nmine\n#### deeper\nyours\n", "# WTON\nlast"]
    assert ("context", "First paragraph\ngoes on.\n\n\n") in a and ("context", "| 2026-01-02 | ABCD |\n") in a and ("context", "  Second, after two blank lines.\n\n") in a
    # What follows the last section on a lower level belongs to it.
    assert [r.kind for r in rows if r.doc == "b"] == [k for k, _ in a]


def test_long_lists_are_cut_at_items_outside_fences(spark):
    text = "".join(f"- item {k} {'x' * 60}\n  more\n" for k in range(20)) + "```\n- fenced\n```\n- after\n~~~~\n- open\n~~~\n- still open\n"
    docs = spark.createDataFrame([("a", "md", text)], "doc string, kind string, text string")
    got = [(r.kind, r.content) for r in sections.partition_documents(docs, codes(spark)).orderBy("ordinal").collect()]
    assert [k for k, _ in got] == ["list_item"] * 21
    assert got[19][1].endswith("```\n- fenced\n```\n") and got[20][1] == "- after\n~~~~\n- open\n~~~\n- still open\n"


def test_csv_and_html_partition(spark):
    csv = '﻿name;note\r\n"Sinar; Jaya";"line\nend ""quoted"" end"\n5" pipe;x\r"open\ncell'
    html = '<html><h2>Title</h2>\n\n<table><tr><th>Kode</th></tr><tr><td>2026-01-05 ABCD</td></tr></table><p>one <b>two</b></p> tail <article><p>in</p></article>'
    docs = spark.createDataFrame([("c", "csv", csv), ("h", "html", html), ("x", "csv", "")], "doc string, kind string, text string")
    records = sections.partition_documents(docs, codes(spark))
    rows = records.orderBy("doc", "ordinal").collect()
    assert "".join(r.content for r in rows if r.doc == "c") == csv and "".join(r.content for r in rows if r.doc == "h") == html
    assert [r.content for r in rows if r.doc == "c"] == ["﻿name;note\r\n", '"Sinar; Jaya";"line\nend ""quoted"" end"\n', '5" pipe;x\r', '"open\ncell']
    assert [r.kind for r in rows if r.doc == "h" and r.kind != "context"] == ["h2", "tr", "tr", "p", "article"]
    noted = {(r.doc, r.ordinal): r for r in sections.annotate_documents(records, docs, codes(spark)).collect()}
    tr = next(r for r in noted.values() if "2026-01-05" in r.content)
    assert tr.context == "Title\n<tr><th>Kode</th></tr>" and tr.event_date == "2026-01-05" and tr.codes == ["ABCD"]
    assert next(r for r in noted.values() if r.kind == "p").context == "Title"
    assert noted["c", 3].context == "name;note"


def test_context_parts_and_passages(spark):
    docs = spark.createDataFrame([("a", "md", MD), ("z", "md", "plain words only " * 40)], "doc string, kind string, text string")
    r = sections.annotate_documents(sections.partition_documents(docs, codes(spark)), docs, codes(spark))
    rows = {x.content: x for x in r.where("doc = 'a'").collect()}
    assert rows["| 2026-01-03 | WIKA GOLD |\n"].context == "Daily report\n| date | code |"
    assert rows["| 2026-01-03 | WIKA GOLD |\n"].codes == ["WIKA"] and rows["| 2026-01-03 | WIKA GOLD |\n"].event_date == "2026-01-03"
    assert rows["### WEGE\nmine\n#### deeper\nyours\n"].context == "Daily report\nOther\nWEGE"
    assert rows["# WTON\nlast"].context == "WTON"
    text = {x.doc: x.text for x in docs.collect()}
    for n in (7, 50, 10_000):
        parts = sections.document_parts(r, docs, n).orderBy("doc", "part").collect()
        for doc in "az":
            own = [p for p in parts if p.doc == doc]
            assert "".join(p.content for p in own) == text[doc] and [p.part for p in own] == list(range(1, len(own) + 1))
            for p in own:
                assert text[doc][p.start : p.end] == p.content and p.line == text[doc][: p.start].count("\n") + 1
                record = next(x for x in r.where(F.col("doc") == doc).collect() if x.start <= p.start < x.end) if n == 50 else None
                assert record is None or (p.context, p.section_id) == (record.context, record.section_id)
    # Passages against the same rule in plain Python, over all records and over a selection.
    rng = random.Random(1)
    for n, chosen in ((40, r), (90, r.where("ordinal % 3 != 1")), (10_000, r)):
        got = {(p.doc, p.passage): p for p in sections.passages(chosen, n).collect()}
        want, last = {}, None
        for x in sorted(chosen.collect(), key=lambda x: (x.doc, x.ordinal)):
            for k in range(0, len(x.content), n):
                piece = x.content[k : k + n]
                gap = "" if last and last[2] == x.start and last[0] == x.doc else "\n…\n"
                if last and not k and last[0] == x.doc and last[1] == x.context and len(want[last[3]]) + len(gap) + len(piece) <= n:
                    want[last[3]] += gap + piece
                    last = (x.doc, x.context, x.end, last[3])
                else:
                    number = last[3][1] + 1 if last and last[0] == x.doc else 1
                    last = (x.doc, x.context, x.end, (x.doc, number))
                    want[last[3]] = piece
        assert {k: p.content for k, p in got.items()} == want
        assert n < 1000 or len(got) < chosen.count() or rng


def test_mentions(spark):
    body = "\n".join([
        "## WTON — PT Wijaya Karya Beton Tbk",
        "Induk PT Wijaya Karya (Persero) Tbk (WIKA) hadir. Lalu rapat.",
        "Wijaya Karya Beton menjual saham.",
        "Wijaya Karya menjual saham lama. Selesai.",
        "harga saham grpm naik; data naik saham.",
        "WEGE menerima pinjaman; GRPM menerima tamu.",
        "(wika) tanpa nama, di (WIKA) juga",
        "- Lampiran WIKA (WIKA) Tbk (WIKA)",
        "lihat berkas.pdf Tbk (WIKA)",
        "[Tbk (WEGE)](http://x/Tbk(WIKA)) @wika_saham https://x.y/Tbk(GRPM) saham_grpm_tbk",
        "",
        "### GRPM dalam WTON",
        "Wijaya Karya Bangunan Gedung adalah anak usaha. Wijaya Karya Beton Tbk (WTON)",
        "## Lain",
        "Tbk (WIKA)",
    ])
    docs = spark.createDataFrame([("d1", "bei-detail", "2026-01-01", body), ("d1", "bei-detail", "2026-01-01", body), ("d2", "keterbukaan-informasi", "2026-01-02", body), ("d3", "stockbit", "2026-01-02", body), ("d4", "bei-detail", "2026-01-02", None)], "doc string, cat string, date string, text string")
    names = spark.createDataFrame([("WIKA", "PT Wijaya Karya (Persero) Tbk"), ("WTON", "PT Wijaya Karya Beton Tbk"), ("WEGE", "PT Wijaya Karya Bangunan Gedung Tbk"), ("NAIK", "PT Naik")], "code string, name string")
    got = {(r.doc, r.line, r.code): (r.filer, r.relation, r.snippet) for r in mentions.scan_mentions(docs, codes(spark), names).collect()}
    one = {k[1:]: v for k, v in got.items() if k[0] == "d1"}
    assert one == {
        (2, "WIKA"): ("WTON", "lain", "Induk PT Wijaya Karya (Persero) Tbk (WIKA) hadir."),
        (4, "WIKA"): ("WTON", "transaksi_saham", "Wijaya Karya menjual saham lama."),
        (5, "GRPM"): ("WTON", "lain", "harga saham grpm naik;"),
        (6, "WEGE"): ("WTON", "kreditur", "WEGE menerima pinjaman;"),
        (10, "WEGE"): ("WTON", "lain", "[Tbk (WEGE)]) @"),
        (13, "WEGE"): ("WTON", "anak_usaha", "Wijaya Karya Bangunan Gedung adalah anak usaha."),
    }
    # Capitals with a relation count in official documents only.
    assert {k[1:] for k in got if k[0] == "d2"} == set(one) - {(6, "WEGE")} and not [k for k in got if k[0] in ("d3", "d4")]
    plain = spark.createDataFrame([("GRPM",)], "word string")
    assert (5, "GRPM") not in {(r.line, r.code) for r in mentions.scan_mentions(docs, codes(spark), names, plain).collect()}
    assert mentions.scan_mentions(docs.limit(0), codes(spark), names).count() == 0 and re.match("x", "x")


def test_annotated_in_one_sort(spark):
    html = "<h1>A</h1><table><tr><th>X</th></tr><tr><td>2026-01-05 ABCD</td></tr><tr><th>Y</th></tr><tr><td>1</td></tr></table><p>out</p><table><tr><td>no head</td></tr></table>"
    md = MD + "\n# Tables\n\n| 2026-02-01 | first |\n\n| 2026-02-02 | same table |\n\nwords\n\n| other | head |\n| 2026-02-03 | WIKA |\n"
    docs = spark.createDataFrame([("a", "md", md), ("c", "csv", "﻿k;v\r\n1;ABCD\r\n"), ("h", "html", html), ("n", "md", None)], "doc string, kind string, text string")
    got = sections.annotated_documents(docs, codes(spark))
    want = sections.annotate_documents(sections.partition_documents(docs, codes(spark)), docs, codes(spark))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    at = {x.content: x for x in got.collect()}
    assert at["| 2026-02-02 | same table |\n\n"].context == "Tables\n| 2026-02-01 | first |" and at["| 2026-02-03 | WIKA |\n"].context == "Tables\n| other | head |"
    assert at["<tr><td>1</td></tr>"].context == "A\n<tr><th>Y</th></tr>" and at["<tr><td>no head</td></tr>"].context == "A"

    def sorts(df, shown):
        return sum("Sort [" in x and shown in x for x in df._jdf.queryExecution().executedPlan().toString().splitlines())

    # Contents are sorted by place once for places and contexts, and once more for passages.
    assert sorts(sections.annotated_documents(docs, codes(spark), named=False), "place") == 1
    packed = sections.passages(sections.annotated_documents(docs, codes(spark), named=False), 90)
    assert sorts(packed, "ordinal") == 1
