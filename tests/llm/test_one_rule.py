"""Mixing follows one rule for any number of sources; templates keep nodes that come late."""

from filingflow.llm import mixing, wrapper

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_sources_without_weight_come_last_in_bundles_too(spark):
    """Beyond max_sources a source without weight was dealt out among those of its bundle, before others had ended."""
    d = spark.createDataFrame([(i, "y" * 10, "en", f"s{i % 60}", 0) for i in range(1200)], DOCS)
    got = mixing.mix(d, {f"s{k}": 1.0 for k in range(0, 60, 2)}, block_chars=20, period=100, max_sources=20).collect()
    even = lambda r: int(r.source[1:]) % 2 == 0
    assert len(got) == 1200 and max(r.slot for r in got if even(r)) < min(r.slot for r in got if not even(r))


def test_one_more_source_than_bundles_moves_few(spark):
    """With one source more than bundles, two sources share one and all others stay alone, so still less than one block off."""
    d = spark.createDataFrame([(i, "y" * 20, "en", f"s{i % 21}", 0) for i in range(4200)], DOCS)
    got = mixing.mix(d, block_chars=20, period=2100, max_sources=20).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.source, set()).add(r.slot)
    far = [s for s, x in slots.items() if any(abs((k + 1) - (slot + 1) / 21) >= 1.2 for k, slot in enumerate(sorted(x)) if slot < 2000)]
    assert len(far) <= 2


def test_a_node_that_comes_late_keeps_its_pages():
    page = lambda more: ["html", 1, [], [["body", 1, [], [["p", 1, [1], []]] + ([["div", 1, [7], []]] if more else [])]]]
    tree = page(False)
    for k in range(1, 65):
        tree = wrapper.merged(tree, page(k >= 32))
    div = wrapper.below(wrapper.below(wrapper.below(0, "html"), "body"), "div")
    assert [div, 7, 33] in wrapper.template_texts(tree)
