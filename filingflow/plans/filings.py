"""Registered queries on reports, filings, files and windows that Spark derives from the driver's orders, lines and documents, with DuckDB
SQL that says what each operator must find from the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.functions.dates import LOCAL_MONTHS
from filingflow.operators import catalog as D
from filingflow.operators import quality as Q
from filingflow.operators import reports as P
from filingflow.plans.registry import Registry
from filingflow.plans.tables import table
from filingflow.sources import files as S

query = Registry()


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.lit(1).alias("period"), F.col("l_linenumber").alias("n"), "l_suppkey", F.col("l_quantity").cast("bigint").alias("shares"))


@query("K20_uncovered_signals", """WITH a AS (SELECT o_custkey, min(o_orderkey) AS told FROM orders GROUP BY 1) SELECT o_custkey AS key, o_orderkey AS id FROM orders JOIN a USING (o_custkey) WHERE o_custkey % 3 = 1 OR (o_custkey % 3 = 2 AND o_orderkey <> told)""")
def k20(spark, d):
    o = _orders(spark, d)
    signals = o.select(F.col("o_custkey").alias("key"), F.col("k").alias("id"), (F.col("k") + 1_000_000).alias("shares"), F.lit("Rimau Tanoko").alias("names"))
    told = F.translate(F.format_number(F.min("k") + 1_000_000, 0), ",", ".")
    answers = o.groupBy(F.col("o_custkey").alias("key")).agg(told.alias("told"))
    said = F.when(F.col("key") % 3 == 0, "Rimau dan Tanoko hadir").when(F.col("key") % 3 == 1, "Rimau tidak ada").otherwise(F.concat(F.lit("sebanyak "), "told", F.lit(" saham")))
    return P.uncovered_signals(signals, answers.select("key", said.alias("answer")), "key")


@query("K25_trust_flags", "SELECT o_orderkey AS entity, o_orderkey % 3 = 0 OR o_orderkey % 4 IN (0, 1) AS comparable, o_orderkey % 4 = 2 AS conflict FROM orders")
def k25(spark, d):
    k = F.col("k")
    issues = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("rounding"))).when(k % 4 == 2, F.array(F.lit("conflict of totals"))).otherwise(F.array(F.lit("rounding"), F.lit("missing")))
    reports = _orders(spark, d).select(k.alias("entity"), F.when(k % 3 == 0, "ok").otherwise("warn").alias("validation"), issues.alias("issues"))
    return P.trust_flags(reports, ["rounding", "note"]).select("entity", "comparable", "conflict")


@query("K26_derivable", "WITH n AS (SELECT l_orderkey AS entity, count(DISTINCT l_quantity) <= 1 AS same, min(l_suppkey % 2) AS low, max(l_suppkey % 2) AS high FROM lineitem GROUP BY l_orderkey, l_linenumber % 3) SELECT entity, bool_and(same) AND min(low) = max(high) AS derivable FROM n GROUP BY 1")
def k26(spark, d):
    v = _lines(spark, d).withColumn("name", F.col("n") % 3).withColumn("pct", F.lit(1.0)).withColumn("total", F.col("l_suppkey") % 2)
    return P.derivable(v).select("entity", "derivable")


@query("K29_written_block", """WITH h AS (SELECT l_orderkey AS entity, l_linenumber * 2.5 AS pct, CAST(l_linenumber * 250 * CASE WHEN l_suppkey % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS shares FROM lineitem),
t AS (SELECT entity, list_sort(list(shares / CAST(pct AS DOUBLE) * 100))[count(*) // 2 + 1] AS implied FROM h GROUP BY 1)
SELECT entity, CAST(sum(CASE WHEN pct >= 5 THEN pct ELSE 0 END) AS DOUBLE) AS written, bool_or(abs(pct - shares / implied * 100) > 1) AS rejected FROM h JOIN t USING (entity) GROUP BY 1""")
def k29(spark, d):
    h = _lines(spark, d).withColumn("pct", F.col("n") * 2.5).withColumn("shares", (F.col("n") * 250 * F.when(F.col("l_suppkey") % 7 == 0, 2).otherwise(1)).cast("bigint"))
    return P.written_block(h.select("entity", "period", "pct", "shares")).select("entity", "written", "rejected")


@query("K31_report_metrics", """WITH g AS (SELECT l_orderkey AS entity, l_linenumber % 2 AS metric, max(CASE WHEN l_linenumber <= 2 THEN CAST(l_quantity AS BIGINT) END) AS value, list_sort(list(DISTINCT CAST(l_quantity AS BIGINT))) AS every FROM lineitem GROUP BY ALL)
SELECT entity, CAST(metric AS INTEGER) AS metric, value, array_to_string(list_filter(every, lambda x: x IS DISTINCT FROM value), ',') AS others FROM g""")
def k31(spark, d):
    v = _lines(spark, d).select("entity", "period", (F.col("n") % 2).cast("int").alias("metric"), F.col("shares").alias("value"), (F.col("n") <= 2).alias("chosen"))
    return P.report_metrics(v).select("entity", "metric", "value", F.array_join("others", ",").alias("others"))


@query("K32_report_rows", """WITH h AS (SELECT l_orderkey AS entity, CASE WHEN l_linenumber % 4 = 0 THEN 'Afiliasi lain' ELSE 'Name ' || l_suppkey % 3 END AS name, CAST(l_quantity AS BIGINT) AS shares, (['1', '3', '8'])[l_linenumber % 3 + 1] AS bits, l_linenumber FROM lineitem)
SELECT entity, name, shares, CAST(bits AS INTEGER) AS role_bits, name LIKE 'Afiliasi%' AS aggregate, count(*) OVER (PARTITION BY entity, name) > 1 AS twice FROM h""")
def k32(spark, d):
    roles = F.get(F.array(F.array(F.lit("block")), F.array(F.lit("block"), F.lit("controller"), F.lit("block")), F.array(F.lit("director"), F.lit("unknown"))), (F.col("n") % 3).cast("int"))
    name = F.when(F.col("n") % 4 == 0, "Afiliasi lain").otherwise(F.concat(F.lit("Name "), F.col("l_suppkey") % 3))
    return P.report_rows(_lines(spark, d).select("entity", "period", name.alias("name"), "shares", roles.alias("roles"))).drop("period")


@query("K34_filings", """SELECT o_orderkey AS url, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'percent off' END, CASE WHEN o_orderkey % 5 = 0 THEN 'role unclear' END], lambda x: x IS NOT NULL), ',') AS notes FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1995-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1997-12-31'""")
def k34(spark, d):
    o = _orders(spark, d).select(F.col("k").alias("url"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("party"), (F.col("k") + 1_000_000).alias("shares"))
    text = F.when(F.col("url") % 2 == 0, F.concat(F.lit("sebanyak "), F.translate(F.format_number("shares", 0), ",", "."), F.lit(" saham"))).otherwise("tanpa angka")
    note = lambda n, kind, what: o.where(F.col("url") % n == 0).select("url", "date", F.lit(kind).alias("kind"), F.lit(what).alias("note"))
    found = P.filings(o.withColumn("text", text), note(3, "percent", "percent off").unionByName(note(5, "role", "role unclear")), "1995-01-01", "1997-12-31")
    return found.select("url", F.coalesce(F.array_join("notes", ","), F.lit("")).alias("notes"))


@query("K35_filing_cards", """SELECT o_orderkey AS id, CAST(sum(CAST(l_quantity AS BIGINT) * (l_linenumber + 1)) AS DOUBLE) AS value, CAST(date_diff('day', max(CAST(l_shipdate AS DATE)), CAST(o_orderdate AS DATE) + 200) AS INTEGER) AS days, count(*) AS change FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def k35(spark, d):
    """Transactions of an order are its lines, a handful."""
    tx = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_quantity").alias("shares"), (F.col("l_linenumber") + 1.0).alias("price"), F.to_date("l_shipdate").alias("date"))).alias("tx"))
    rows = tx.join(_orders(spark, d).select(F.col("k").alias("id"), F.date_add(F.to_date("o_orderdate"), 200).alias("date")), "id")
    return P.filing_cards(rows.withColumn("before", F.lit(10).cast("bigint")).withColumn("after", F.col("before") + F.size("tx")))


@query("Q04_not_shrinking", "SELECT CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders")
def q04(spark, d):
    days = _orders(spark, d).select(F.to_date("o_orderdate").alias("day"), "k")
    kept = Q.assert_not_shrinking(days.where("k % 3 = 0"), days.where("k % 3 = 1"), days.where("k % 3 = 2"), days.where("k % 5 = 0"))
    return spark.createDataFrame([(kept,)], "days bigint")


@query("Q10_check_files", """SELECT CAST(doc_id AS VARCHAR) AS name, array_to_string(list_filter([CASE WHEN doc_id % 7 = 3 THEN 'name' END, CASE WHEN doc_id % 7 <> 3 AND doc_id % 5 = 2 THEN 'category' END, CASE WHEN doc_id % 7 <> 3 AND doc_id % 4 = 1 THEN 'hash' END,
  CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN regexp_matches(text, 'Apache') THEN 'quarantine' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents""")
def q10(spark, d):
    t = table(spark, d, "documents")
    k = F.col("doc_id")
    files = t.select(k.cast("string").alias("name"), F.lit("a").alias("cat"), F.col("text").alias("body"))
    expected = t.where(k % 7 != 3).select(k.cast("string").alias("name"), F.when(k % 5 == 2, "b").otherwise("a").alias("cat"), F.when(k % 4 == 1, "x").otherwise(F.sha2("text", 256)).alias("sha"))
    return Q.check_files(files, expected, "Apache")


@query("Q13_check_windows", """WITH w AS (SELECT o_orderkey, 'w' || o_custkey % 9000 AS name, CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 08:30' END AS "start", strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 7 = 0 THEN ' 08:00' ELSE ' 09:00' END AS "end" FROM orders)
SELECT name, "start", "end", array_to_string(list_filter([CASE WHEN o_orderkey % 9 = 0 THEN 'time' END, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 7 = 0 THEN 'order' END, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'twice' END], lambda x: x IS NOT NULL), ',') AS issues FROM w""")
def q13(spark, d):
    k, day = F.col("k"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = _orders(spark, d).select(F.concat(F.lit("w"), F.col("o_custkey") % 9000).alias("name"), F.when(k % 9 == 0, "bad").otherwise(F.concat(day, F.lit(" 08:30"))).alias("start"), F.concat(day, F.when(k % 7 == 0, " 08:00").otherwise(" 09:00")).alias("end"))
    return Q.check_windows(rows)


@query("S09_detect_delimiter", "SELECT o_orderkey, (['comma', 'semicolon', 'tab', 'comma'])[CAST(o_orderkey % 4 + 1 AS BIGINT)] AS delimiter FROM orders")
def s09(spark, d):
    text = F.get(F.array(*map(F.lit, ["a,b,c;d\n1;2;3;4;5", "a;b;c,d", "a\tb\tc;d", "one column"])), (F.col("k") % 4).cast("int"))
    found = S.detect_delimiter(_orders(spark, d).select("o_orderkey", text.alias("text")), "text")
    return found.select("o_orderkey", F.when(F.col("delimiter") == ",", "comma").when(F.col("delimiter") == ";", "semicolon").otherwise("tab").alias("delimiter"))


@query("S11_ledger_summary", """WITH h AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE o_orderkey % 4 <> 0), f AS (SELECT o_custkey AS entity, count(*) AS filings, max(CAST(o_orderdate AS DATE)) AS last_filing FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS entity, min(strftime(o_orderdate, '%Y-%m')) AS first_month, max(strftime(o_orderdate, '%Y-%m')) AS last_month FROM orders GROUP BY 1)
SELECT entity, coalesce(filings, 0) AS filings, last_filing, first_month, last_month FROM h LEFT JOIN f USING (entity) LEFT JOIN b USING (entity)""")
def s11(spark, d):
    o = _orders(spark, d).withColumn("entity", F.col("o_custkey"))
    return S.ledger_summary(o.select("entity", F.col("k").alias("file_id")), o.select(F.col("k").alias("file_id"), (F.col("k") % 4 != 0).alias("active")), o.where("o_orderstatus = 'F'").select("entity", F.to_date("o_orderdate").alias("date")), o.select("entity", F.date_format("o_orderdate", "yyyy-MM").alias("month")))


@query("S16_entity_codes", "SELECT DISTINCT p_brand AS code FROM part UNION SELECT DISTINCT o_orderpriority FROM orders")
def s16(spark, d):
    return S.entity_codes(table(spark, d, "part").select(F.col("p_brand").alias("entity")), _orders(spark, d).select(F.array("o_orderpriority").alias("codes")))


SPANS = """WITH o AS (SELECT o_orderkey AS id, date_trunc('month', o_orderdate + INTERVAL 240 MONTH)::DATE AS m FROM orders),
r AS (SELECT id, CASE WHEN id % 3 = 0 THEN m + 27 ELSE m + 2 END AS "start", CASE WHEN id % 3 = 0 THEN (m + INTERVAL 1 MONTH)::DATE + 4 ELSE m + 16 END AS "end" FROM o WHERE id % 5 <> 4)"""


def _written(spark, d) -> tuple[DataFrame, DataFrame]:
    """Texts that write a span of days, over two months or within one, or none; and their ranges."""
    month = F.trunc(F.add_months("o_orderdate", 240), "month")
    name = lambda m: F.get(F.array(*map(F.lit, LOCAL_MONTHS)), F.month(m) - 1)
    after = F.add_months("m", 1)
    two = F.concat(F.lit("28 "), name(F.col("m")), F.lit(" "), F.year("m"), F.lit(" – 5 "), name(after), F.lit(" "), F.year(after))
    text = F.when(F.col("id") % 5 == 4, "tanpa tanggal").when(F.col("id") % 3 == 0, two).otherwise(F.concat(F.lit("3–17 "), name(F.col("m")), F.lit(" "), F.year("m")))
    docs = _orders(spark, d).select(F.col("k").alias("id"), month.alias("m")).withColumn("text", F.concat(F.lit("Periode "), text, F.lit(" untuk semua")))
    return docs, D.text_date_ranges(docs, "id", "text")


@query("D02_text_date_ranges", f'{SPANS} SELECT id, "start", "end" FROM r')
def d02(spark, d):
    return _written(spark, d)[1].select("id", "start", "end")


@query("D03_refine_dates", f"""{SPANS} SELECT id, CASE WHEN id % 2 = 0 AND id % 3 <> 0 AND id % 5 <> 4 THEN m + 2 WHEN id % 2 = 0 THEN m ELSE m + 27 END AS "start",
  CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 <> 0 AND id % 5 <> 4 THEN m + 16 ELSE (m + INTERVAL 1 MONTH)::DATE - 1 END WHEN id % 3 = 0 AND id % 5 <> 4 THEN (m + INTERVAL 1 MONTH)::DATE + 4 ELSE m + 27 END AS "end", CASE WHEN id % 2 = 0 AND (id % 3 = 0 OR id % 5 = 4) THEN 'month' ELSE 'day' END AS precision FROM o""")
def d03(spark, d):
    """Even ones name a month, odd ones the day on which a span over two months begins."""
    docs, ranges = _written(spark, d)
    even = F.col("id") % 2 == 0
    spans = docs.select("id", F.when(even, F.col("m")).otherwise(F.date_add("m", 27)).alias("start"), F.when(even, F.last_day("m")).otherwise(F.date_add("m", 27)).alias("end"), F.when(even, "month").otherwise("day").alias("precision"))
    return D.refine_dates(spans, ranges, "id")


@query("D04_covers", f"""{SPANS} SELECT id, CASE WHEN id % 2 = 0 AND id % 3 <> 0 AND id % 5 <> 4 THEN m + 2 ELSE m + 16 END AS "start", m + 16 AS "end" FROM o WHERE id % 2 = 0 UNION ALL SELECT id, m, m + 16 FROM o WHERE id % 2 = 1""")
def d04(spark, d):
    docs, ranges = _written(spark, d)
    spans = docs.select("id", F.when(F.col("id") % 2 == 0, F.date_add("m", 16)).otherwise(F.col("m")).alias("start"), F.date_add("m", 16).alias("end"))
    return D.covers(spans, ranges, "id")


QUERIES, SQL = query.queries, query.sql
