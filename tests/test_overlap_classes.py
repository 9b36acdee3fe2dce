"""The overlap join in the form of classes loses no pair, and repeated rows add no pairs."""

import datetime as dt
import random

from filingflow.operators import relational as rel


def test_classes_hold_every_pair(spark):
    r = random.Random(7)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(90)) if r.random() < 0.95 else None
    span = lambda k: (k, r.choice(["x", "y", None]), day(), day())
    docs, ranges = [span(k) for k in range(150)], [span(k) for k in range(120)]
    copies = lambda rows, n: rows + [(k + 1000 * c, *rest) for c in range(1, n) for k, *rest in rows]
    sizes = []
    for n in (1, 4):
        a, b = copies(docs, n), copies(ranges, n)
        rows = rel.overlap_classes(spark.createDataFrame(a, "doc int, cat string, start date, end date"), spark.createDataFrame(b, "range int, cat string, low date, high date"), "doc", "range", "start", "end", "low", "high", ["cat"], 7).collect()
        of = {kind: [(x.a, x.b) for x in rows if x.kind == kind] for kind in ("left", "range", "pair")}
        assert sorted(x for x, _ in of["left"]) == sorted(x[0] for x in a) and sorted(x for x, _ in of["range"]) == sorted(x[0] for x in b)
        assert len(of["pair"]) == len(set(of["pair"]))
        pairs = set(of["pair"])
        got = {(x, y) for x, p in of["left"] for y, q in of["range"] if (p, q) in pairs}
        want = {(x, y) for x, c, s, e in a for y, k, l, h in b if c is not None and c == k and None not in (s, e, l, h) and s <= e and l <= h and s <= h and l <= e}
        assert got == want and got
        sizes.append(len(pairs))
    assert sizes[0] == sizes[1]
