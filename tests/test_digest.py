"""Segments of daily files, and plans against a plain version of the rule on random segments."""

import random

import pytest

from filingflow.operators import digest as D

TEXT = """# Daily
intro line

## Sorotan
hot
## ABCD — PT Abcd
own
### EFGH inside an issuer
stays
## Emiten lain
opening
### 1. EFGH — PT Efgh
- [Mengutip keterbukaan] x
### No code
stays too
### IJKL
y
## Lampiran: semua
- a
## Jadwal
z"""
CODES = ["ABCD", "EFGH", "IJKL", "MNOP", "QRST"]


def test_segments(spark):
    codes = spark.createDataFrame([(c,) for c in CODES], "code string")
    docs = spark.createDataFrame([("a", TEXT), ("b", TEXT[: TEXT.index("## ABCD")] + TEXT[TEXT.index("## Emiten") :]), ("c", ""), ("d", None), ("e", "no heading")], "doc string, text string")
    rows = D.daily_segments(docs, codes).orderBy("doc", "place").collect()
    text = {r.doc: r.text for r in docs.collect()}
    for doc in "abe":
        assert "".join(r.text for r in rows if r.doc == doc) == text[doc]
    a = [(r.kind, r.code, r.tier, r.parent, r.line) for r in rows if r.doc == "a"]
    assert a == [("pre", None, None, None, 1), ("head", None, None, None, 4), ("issuer", "ABCD", 1, None, 6), ("intro", None, None, None, 10), ("issuer", "EFGH", 2, 4, 12), ("issuer", "IJKL", 2, 4, 16), ("appendix", None, None, None, 18), ("aux", None, None, None, 20)]
    # Without sections of their own, those inside a container are the first tier.
    assert [(r.kind, r.code, r.tier) for r in rows if r.doc == "b"] == [("pre", None, None), ("head", None, None), ("intro", None, None), ("issuer", "EFGH", 1), ("issuer", "IJKL", 1), ("appendix", None, None), ("aux", None, None)]
    assert [r.kind for r in rows if r.doc == "e"] == ["pre"] and not [r for r in rows if r.doc in "cd"]
    s = {r.place: r for r in D.sized(D.daily_segments(docs, codes)).where("doc = 'a'").collect()}
    assert s[5].quoted and not s[3].quoted and s[3].size == sum(s[3].lines) and s[3].listed == len("- ABCD — PT Abcd".encode()) + 1


SEGMENTS = "request string, doc string, day string, cat string, place int, kind string, code string, tier int, parent int, size int, lines array<int>, quoted boolean, listed int, head_only boolean"


def random_request(rng, name):
    rows = []
    for k in range(rng.randint(1, 4)):
        kinds = ["pre", "head"] + ["issuer"] * rng.randint(0, 6) + (["intro"] + ["child"] * rng.randint(1, 4)) * rng.randint(0, 1) + ["aux"] * rng.randint(0, 2) + ["appendix"] * rng.randint(0, 1)
        parent = None
        for place, kind in enumerate(kinds, 1):
            lines = [rng.randint(5, 700) for _ in range(rng.randint(1, 12))]
            parent = place if kind == "intro" else parent
            issuer = kind in ("issuer", "child")
            rows.append((name, f"d{k}", f"2026-01-{1 + k // 2:02}", "ab"[k % 2], place, "issuer" if issuer else kind, rng.choice(CODES) if issuer else None, (2 if kind == "child" and "issuer" in kinds else 1) if issuer else None, parent if kind == "child" else None, sum(lines), lines, rng.random() < 0.3, rng.randint(10, 160), rng.random() < 0.15 and False if place == 1 else None))
    flags = {r[1]: rng.random() < 0.2 for r in rows}
    return [(*r[:13], flags[r[1]]) for r in rows]


def plain_plan(rows, budget, exhaustive, preferred):
    """The rule on dictionaries, one step after the other."""
    docs = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[1], r[4])):
        s = dict(zip((c.split()[0] for c in SEGMENTS.split(", ")), r), taken=0, late=False)
        if s["kind"] == "appendix":
            s |= {"kind": "aux"} if exhaustive else {"kind": "note", "size": s["listed"] + 80, "lines": [s["listed"] + 80]}
        s["pref"] = s["kind"] == "issuer" and s["code"] in preferred
        s["tier"] = 1 if s["pref"] else s["tier"]
        s["own"] = not s["head_only"] or s["kind"] in ("pre", "head", "note", "aux")
        docs.setdefault((r[2], r[3], r[1]), {})[r[4]] = s
    everything = [s for d in docs.values() for s in d.values()]
    up = lambda s: next((d[s["parent"]] for d in docs.values() if s["parent"] in d and d.get(s["place"]) is s), None) if s["parent"] else None

    def cut(s, limit):
        if s["size"] <= limit:
            return s["size"]
        n = 0
        for line in s["lines"]:
            if n and n + line > limit - 80:
                break
            n += min(line, max(100, limit - 80))
        return n + 80

    if sum(s["size"] for s in everything if s["own"]) <= budget:
        return {(s["doc"], s["place"]): (s["size"] if s["own"] else 0, False) for s in everything}
    heads = {k: [s for s in d.values() if s["kind"] in ("pre", "head", "note")] for k, d in docs.items()}
    total = sum(s["size"] for h in heads.values() for s in h)
    for h in heads.values():
        room = budget if total <= 0.6 * budget else int(0.6 * budget / len(docs))
        for s in h:
            if s["size"] <= room:
                s["taken"] = s["size"]
            elif room >= 600:
                s["taken"] = cut(s, room)
            room -= s["taken"]
    queues, seen = [], set()
    for d in docs.values():
        q = [s for s in d.values() if s["own"] and s["kind"] in ("issuer", "aux")]
        q = [s for s in q if s["pref"]] + [s for s in q if not s["pref"]]
        tier = [s for s in q if s["tier"] == 1]
        for s in tier:
            s["late"] = s["code"] in seen and not s["pref"]
        seen.update(s["code"] for s in tier[:10])
        groups = [[s for s in tier if s["late"] is late and bool(s["pref"] or s["quoted"]) is said] for late in (False, True) for said in (True, False)]
        queues.append([s for g in groups for s in g] + [s for s in q if s["tier"] != 1])
    used = lambda: sum(s["taken"] for s in everything)
    missing = lambda: sum(s["listed"] for q in queues for s in q if not s["taken"])

    def spend(test, size, left):
        stacks = [[s for s in q if test(s)] for q in queues]
        while any(stacks):
            for stack in stacks:
                if not stack:
                    continue
                s, want = stack[0], size(stack[0])
                intro = up(s)["size"] if up(s) and not up(s)["taken"] else 0
                cost = max(0, want - s["taken"]) + intro
                if cost > left:
                    del stack[:]
                    continue
                left -= cost
                if want > s["taken"]:
                    if intro:
                        up(s)["taken"] = intro
                    s["taken"] = want
                stack.pop(0)
        return left

    open1 = lambda s: s["tier"] == 1 and not s["taken"]
    open2 = lambda s: s["tier"] == 2 and not s["taken"]
    aux = lambda s: s["kind"] == "aux" and not s["taken"]
    lead, whole = (lambda s: cut(s, 1100)), (lambda s: s["size"])
    left = max(0, budget - used() - min(int(0.15 * budget), missing()))
    part = int(left * (0.4 if exhaustive else 0.55))
    left = left - part + spend(open1, lead, part)
    cap = max(6000, left // (3 * len(docs)))
    left = spend(lambda s: s["tier"] == 1 and 0 < s["taken"] < s["size"], lambda s: cut(s, cap), left)
    for test, size in ((open1, lead), (open2, whole), (aux, whole)):
        left = spend(test, size, left)
    spare = budget - used() - missing() - 120 * len(docs)
    for test, size in ((open1, lead), (open2, whole), (aux, whole)):
        spare = spend(test, size, spare) if spare > 0 else 0
    return {(s["doc"], s["place"]): (s["taken"], s["late"]) for s in everything}


@pytest.mark.parametrize("budget,exhaustive,preferred", [(4000, False, frozenset()), (9000, True, frozenset({"ABCD"})), (25_000, False, frozenset({"QRST"})), (10**6, False, frozenset())])
def test_plans(spark, budget, exhaustive, preferred):
    rng = random.Random(budget)
    requests = {f"r{k}": random_request(rng, f"r{k}") for k in range(40)}
    df = spark.createDataFrame([r for rows in requests.values() for r in rows], SEGMENTS).repartition(5)
    got = {}
    for r in D.digest_plan(df, budget, exhaustive, preferred).collect():
        got.setdefault(r.request, {})[r.doc, r.place] = (r.taken, r.late)
    for name, rows in requests.items():
        assert got[name] == plain_plan(rows, budget, exhaustive, preferred), name
        # Only a first line of a head or lead that is longer than its room can pass the budget.
        assert sum(t for t, _ in got[name].values()) <= budget + 700 * 4
    assert D.digest_plan(df.limit(0), budget).count() == 0
