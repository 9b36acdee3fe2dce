"""Name lookup and HTML records on small fixtures."""

from filingflow.operators import lookup as K
from filingflow.operators.html_records import html_records
from filingflow.sources.files import entity_codes


def test_lookup(spark):
    tokens = K.name_tokens(spark.createDataFrame([("Sukanto Widjaja",), ("Prajogo Group",), ("Hartono Bersama",)], "name string"))
    vocabulary = spark.createDataFrame([("prajogo", 5), ("hartono", 3), ("tanoto", 4), ("saham", 900)], "term string, docs bigint")
    one = lambda *x: spark.createDataFrame([(w,) for w in x], "token string")
    texts = spark.createDataFrame([(1, "apa kabar prajogo saham"), (2, "tentang Prajogo Tanoto"), (3, "apa hartonp beli"), (4, "hartono saham"), (5, None), (6, "")], "id int, text string")
    got = K.lookup_entities(texts, "id", "text", tokens, vocabulary, one("prajogo", "hartono"), one("tentang", "apa"), one("bersama")).collect()
    assert {(r.id, r.token, r.fuzzy, tuple(r.names)) for r in got} == {(1, "prajogo", False, ("Prajogo Group",)), (3, "hartono", True, ("Hartono Bersama",)), (4, "hartono", False, ("Hartono Bersama",))}


def test_html_records(spark):
    html = "<ul><li>a<ul><li>b</li></ul></li></ul><!-- <p>no</p> --><script>if (a<b) '<p>x</p>'</script><h2 title='a>b'>T</h2><P>q</P><p>open"
    rows = html_records(spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string"), "id", "html").orderBy("ordinal").collect()
    assert [(r.tag, r.content) for r in rows] == [("li", "<li>a<ul><li>b</li></ul></li>"), ("script", "<script>if (a<b) '<p>x</p>'</script>"), ("h2", "<h2 title='a>b'>T</h2>"), ("p", "<P>q</P>")]
    assert all(html[r.offset :].startswith(r.content) and r.id == 1 for r in rows)


def test_entity_codes(spark):
    found = entity_codes(spark.createDataFrame([("A",), ("B",)], "entity string"), spark.createDataFrame([(["B", "C"],), (None,)], "codes array<string>"))
    assert sorted(r.code for r in found.collect()) == ["A", "B", "C"]
