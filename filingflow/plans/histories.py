"""Registered queries on histories of lists, spellings and mixed cells, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions.dates import LOCAL_MONTHS
from filingflow.operators import reports as P
from filingflow.operators import signals as K
from filingflow.operators import structure as A
from filingflow.operators.mentioned_dates import date_mentions
from filingflow.plans.registry import Registry
from filingflow.plans.tables import POSITIONS, positions, table
from filingflow.sources import files as S

LISTS = f"""{POSITIONS},
lists AS (SELECT entity, year(period) * 12 + month(period) AS idx, CASE WHEN month(period) % 7 = 0 THEN NULL ELSE [CAST(count(*) // 5 AS VARCHAR), CAST(max(party) // 20 AS VARCHAR)] END AS holders FROM positions GROUP BY entity, period),
before AS (SELECT *, last_value(holders IGNORE NULLS) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM lists),
same AS (SELECT *, coalesce(last = holders, false) AS same FROM before)"""
query, plain = Registry(LISTS), Registry()


def _lists(spark, d) -> DataFrame:
    g = positions(spark, d).groupBy("entity", (F.year("period") * 12 + F.month("period")).alias("idx"), F.month("period").alias("m")).agg(F.count("*").alias("n"), F.max("party").alias("p"))
    return g.select("entity", "idx", F.when(F.col("m") % 7 != 0, F.array(F.floor(F.col("n") / 5).cast("string"), F.floor(F.col("p") / 20).cast("string"))).alias("holders"))


@query("S07_compress_repeats", "SELECT entity, CAST(idx AS INTEGER) AS idx, CAST(CASE WHEN same THEN max(CASE WHEN holders IS NOT NULL AND NOT same THEN idx END) OVER (PARTITION BY entity ORDER BY idx) END AS INTEGER) AS ref, CASE WHEN NOT same THEN array_to_string(holders, ',') END AS holders FROM same")
def s07(spark, d):
    return S.compress_repeats(_lists(spark, d)).select("entity", "idx", "ref", F.array_join("holders", ",").alias("holders"))


@query("S06_resolve_backrefs", "SELECT entity, CAST(idx AS INTEGER) AS idx, array_to_string(holders, ',') AS holders FROM lists")
def s06(spark, d):
    return S.resolve_backrefs(S.compress_repeats(_lists(spark, d))).select("entity", "idx", F.array_join("holders", ",").alias("holders"))


@query("K04_merge_variants", """, placed AS (SELECT entity, party, dense_rank() OVER (ORDER BY period) AS place FROM positions),
series AS (SELECT entity, party, place // 17 AS v, min(place) AS a, max(place) AS b FROM placed GROUP BY ALL),
chained AS (SELECT *, CASE WHEN lag(b) OVER w + 1 = a THEN 0 ELSE 1 END AS new FROM series WINDOW w AS (PARTITION BY entity, party ORDER BY v)),
island AS (SELECT *, sum(new) OVER (PARTITION BY entity, party ORDER BY v) AS i FROM chained)
SELECT entity, 'P' || party || ' v' || v AS party, 'P' || party || ' v' || min(v) OVER (PARTITION BY entity, party, i) AS merged FROM island""")
def k04(spark, d):
    """Every party is spelled anew after some months; a spelling continues the one before where no month is missing between."""
    p = positions(spark, d)
    months = p.select("period").distinct()
    place = months.withColumn("place", F.row_number().over(Window.orderBy("period")))
    spelled = F.concat(F.lit("P"), "party", F.lit(" v"), F.floor(F.col("place") / 17))
    rows = p.join(place, "period").select("entity", spelled.alias("party"), "period", "shares", F.lit(5.0).alias("pct"), F.col("party").alias("key"))
    return K.merge_variants(rows.drop("key"), rows.select("party", "key").distinct(), months)


@plain("A13_match_variants", """SELECT 'PT ' || c_name || ' Jaya' AS name_a, CASE c_custkey % 4 WHEN 0 THEN 'Jaya ' || c_name || ' Tbk' ELSE 'Cust Makmur ' || c_custkey END AS name_b FROM customer WHERE c_custkey % 4 < 2""")
def a13(spark, d):
    """Words in another order, the beginning of a word with equal shares, nothing in common, and two that fit one."""
    c = table(spark, d, "customer")
    k, lit = F.col("c_custkey"), F.lit
    a = c.select(F.concat(lit("PT "), "c_name", lit(" Jaya")).alias("name"), (k * 10).cast("bigint").alias("shares"))
    one = F.when(k % 4 == 0, F.concat(lit("Jaya "), "c_name", lit(" Tbk"))).when(k % 4 == 1, F.concat(lit("Cust Makmur "), k)).otherwise(F.concat(lit("Lain "), k))
    b = c.select(one.alias("name"), F.when(k % 4 == 1, k * 10).otherwise(-k).cast("bigint").alias("shares"))
    twice = c.where(k % 4 == 3).select(F.explode(F.array(F.concat("c_name", lit(" Jaya")), F.concat(lit("Jaya PT "), "c_name"))).alias("name"), lit(0).cast("bigint").alias("shares"))
    return P.match_variants(a, b.unionByName(twice))


@plain("A16_natural_order", """SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_custkey % 5 WHEN 3 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END, CASE c_custkey % 5 WHEN 0 THEN c_custkey % 100 + 0.5 WHEN 4 THEN 1000 + c_custkey % 1000 + 0.25 ELSE c_custkey % 100 END * CASE WHEN c_custkey % 5 = 3 THEN 0 ELSE 1 END, c_custkey) AS INTEGER) AS up,
  CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_custkey % 5 WHEN 3 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 END, CASE c_custkey % 5 WHEN 0 THEN c_custkey % 100 + 0.5 WHEN 4 THEN 1000 + c_custkey % 1000 + 0.25 ELSE c_custkey % 100 END * CASE WHEN c_custkey % 5 = 3 THEN 0 ELSE -1 END, c_custkey) AS INTEGER) AS down FROM customer""")
def a16(spark, d):
    k, lit = F.col("c_custkey"), F.lit
    cell = F.when(k % 5 == 0, F.concat(k % 100, lit(",5"))).when(k % 5 == 1, F.concat(lit("item "), k % 100)).when(k % 5 == 2, F.concat(lit("Ítem "), F.lpad((k % 100).cast("string"), 4, "0"))).when(k % 5 == 3, lit("")).otherwise(F.concat(lit("1."), F.lpad((k % 1000).cast("string"), 3, "0"), lit(",25")))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", cell.alias("cell"))
    place = lambda down: F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*A.smart_order("cell", "c_custkey", down)))
    return c.select("c_custkey", place(False).alias("up"), place(True).alias("down"))


ASKED = """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderdate + INTERVAL 240 MONTH AS DATE) AS x FROM orders),
s AS (SELECT o_orderkey, x AS a, x AS b FROM o WHERE k < 4 UNION ALL SELECT o_orderkey, make_date(2015, month(x), 5), make_date(2015, month(x), 5) FROM o WHERE k = 4 UNION ALL SELECT o_orderkey, make_date(2015, month(x), 10), make_date(2015, month(x), 10) FROM o WHERE k = 4
  UNION ALL SELECT o_orderkey, make_date(year(x), month(x), 3), make_date(year(x), month(x), 17) FROM o WHERE k = 5 UNION ALL SELECT o_orderkey, x, x + 40 FROM o WHERE k = 6 UNION ALL SELECT o_orderkey, DATE '2016-05-09', DATE '2016-05-15' FROM o WHERE k = 7)
SELECT o_orderkey, a AS "from", b AS "to" FROM s"""


@plain("D17_date_mentions", ASKED)
def d17(spark, d):
    """Questions about the date of an order: written in six ways, with misspelled months, lists, ranges and weeks."""
    x, k, lit = F.add_months("o_orderdate", 240), F.col("o_orderkey") % 8, F.lit
    month = F.get(F.array(*map(F.lit, LOCAL_MONTHS)), F.month(x) - 1)
    wrong = F.concat(month, F.when(F.length(month) >= 6, F.substring(month, -1, 1)).otherwise(""))
    full = lambda c, m: F.concat_ws(" ", F.dayofmonth(c), m, F.year(c))
    said = F.when(k == 0, F.concat(lit("tanggal "), x.cast("string"))).when(k == 1, F.concat_ws("/", F.dayofmonth(x), F.month(x), F.year(x))).when(k == 2, F.concat(lit("ada apa "), full(x, wrong), lit("?")))
    said = said.when(k == 3, F.concat(month, lit(" "), F.dayofmonth(x), lit(", "), F.year(x))).when(k == 4, F.concat(lit("5 dan 10 "), month)).when(k == 5, F.concat(lit("dari 3-17 "), month, lit(" "), F.year(x)))
    said = said.when(k == 6, F.concat(x.cast("string"), lit(" sampai tanggal "), F.date_add(x, 40).cast("string"))).otherwise("apa saja minggu lalu")
    return date_mentions(table(spark, d, "orders").select("o_orderkey", said.alias("text")), "o_orderkey", "text", 2015, "2016-05-18")


QUERIES, SQL = query.queries | plain.queries, query.sql | plain.sql
