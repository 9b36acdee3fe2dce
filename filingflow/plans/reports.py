"""Registered queries on issuer reports (K, A), with DuckDB SQL. A brand's order lines of a year stand for a report's versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.operators import parties as I
from filingflow.operators import reports as P
from filingflow.plans.registry import Registry
from filingflow.plans.tables import POSITIONS, positions, table

query = Registry(POSITIONS)
plain = Registry()

VERSIONS = "versions AS (SELECT o_custkey % 50 AS entity, CAST(date_trunc('year', o_orderdate) AS DATE) AS period, o_orderkey AS id, o_orderstatus = 'F' AS valid, CAST(o_orderdate AS DATE) AS stamp FROM orders)"


def _versions(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("entity"), F.trunc("o_orderdate", "year").alias("period"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("valid"), F.to_date("o_orderdate").alias("stamp"))


@plain("K27_preferred", f"WITH {VERSIONS} SELECT entity, period, id FROM versions QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY CAST(valid AS INTEGER) DESC, (stamp, id) DESC) = 1")
def k27(spark, d):
    v = _versions(spark, d).withColumn("s", F.struct("stamp", "id"))
    return P.preferred(v, ["entity", "period"], "valid", "s").select("entity", "period", "id")


@query("K28_blockholders", ", h AS (SELECT *, CAST(sum(shares) OVER (PARTITION BY entity, period) AS BIGINT) AS total FROM positions) SELECT entity, period, CAST(sum(CASE WHEN shares * 100 >= 5 * total THEN 1 ELSE 0 END) AS BIGINT) AS holders, CAST(sum(CASE WHEN shares * 100 >= 5 * total THEN shares ELSE 0 END) AS BIGINT) AS block_shares, CAST(floor(1000000.0::DOUBLE * CAST(sum(CASE WHEN shares * 100 >= 5 * total THEN shares ELSE 0 END) AS BIGINT) / max(total)) AS BIGINT) AS block_ppm, true AS reconciled FROM h GROUP BY entity, period")
def k28(spark, d):
    p = positions(spark, d)
    total = p.groupBy("entity", "period").agg(F.sum("shares").alias("total"))
    return P.blockholders(p.join(total, ["entity", "period"]))


@query("K30_coalesce_sources", ", k AS (SELECT entity, party, max(CASE WHEN year(period) = 1997 THEN shares END) AS r, max(CASE WHEN year(period) = 1998 AND month(period) < 4 THEN shares END) AS k, max(CASE WHEN year(period) = 1999 THEN shares END) AS p FROM positions GROUP BY ALL) SELECT entity, party, coalesce(r, k, p) AS value, CASE WHEN r IS NOT NULL THEN 'R' WHEN k IS NOT NULL THEN 'K' ELSE 'P' END AS source FROM k WHERE coalesce(r, k, p) IS NOT NULL")
def k30(spark, d):
    p = positions(spark, d)
    side = lambda cond: p.where(cond).groupBy("entity", "party").agg(F.max("shares").alias("value"))
    return P.coalesce_sources(side("year(period) = 1997"), side("year(period) = 1998 and month(period) < 4"), side("year(period) = 1999"), ["entity", "party"])


@query("K33_owner_types", ", s AS (SELECT n_regionkey AS domicile, party AS type, CAST(sum(CASE WHEN period = DATE '1996-03-01' THEN shares END) AS BIGINT) AS a, CAST(sum(CASE WHEN period = DATE '1996-04-01' THEN shares END) AS BIGINT) AS b FROM positions JOIN nation ON n_nationkey = party WHERE period IN (DATE '1996-03-01', DATE '1996-04-01') GROUP BY ALL) SELECT domicile, type, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(grouping(domicile, type) AS BIGINT) AS level FROM s GROUP BY ROLLUP (domicile, type)")
def k33(spark, d):
    p = positions(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("party"), F.col("n_regionkey").alias("domicile")), "party")
    side = lambda day: p.where(F.col("period") == F.lit(day).cast("date")).groupBy("domicile", F.col("party").alias("type")).agg(F.sum("shares").alias("shares"))
    return P.owner_types(side("1996-03-01"), side("1996-04-01"))


@query("A12_compare_reports", ", a AS (SELECT party AS name, 'r' || (party + month(period)) % 3 AS role, shares FROM positions WHERE entity = 'Brand#7' AND period = DATE '1996-03-01'), b AS (SELECT party AS name, 'r' || (party + month(period) * 2) % 3 AS role, shares FROM positions WHERE entity = 'Brand#7' AND period = DATE '1996-04-01')\nSELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN a.role ELSE b.role END AS role, a.shares AS shares_a, b.shares AS shares_b, CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' WHEN a.role = b.role THEN 'role' ELSE 'name' END AS how FROM a FULL JOIN b ON a.name = b.name")
def a12(spark, d):
    p = positions(spark, d).where("entity = 'Brand#7'")
    side = lambda day, k: p.where(F.col("period") == F.lit(day).cast("date")).select(F.col("party").alias("name"), F.concat(F.lit("r"), (F.col("party") + F.month("period") * k) % 3).alias("role"), "shares")
    return P.compare_reports(side("1996-03-01", 1), side("1996-04-01", 2))


@plain("A14_in_range", "SELECT o_orderkey, CAST(o_orderdate AS DATE) > DATE '1997-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30' AS inside FROM orders")
def a14(spark, d):
    return P.in_range(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), "date", "1997-01-01", "1997-06-30").select("o_orderkey", "inside")


#: Spellings of a nation's name in a period: in some periods two at a time for one nation in five, which puts what follows in doubt.
SPELLINGS = """, spelled AS (SELECT entity, period, party, unnest(CASE WHEN party % 5 = 0 AND month(period) = 7 AND year(period) = 1997 THEN ['PT ' || n_name, n_name || ' (PERSERO) TBK'] ELSE [CASE month(period) % 3 WHEN 0 THEN 'PT. ' || n_name WHEN 1 THEN n_name || ' Tbk' ELSE 'A/C ' || n_name END] END) AS name, month(period) % 3 = 2 AS account FROM positions JOIN nation ON n_nationkey = party),
split AS (SELECT entity, period, party, name, party % 5 = 0 AND month(period) = 7 AND year(period) = 1997 AS twice, CASE WHEN account AND NOT (party % 5 = 0 AND month(period) = 7 AND year(period) = 1997) THEN 'a' ELSE 'n' END AS kind FROM spelled)"""


@query("K24_assign_party_ids", f"""{SPELLINGS}, once AS (SELECT *, max(CASE WHEN twice THEN period END) OVER (PARTITION BY entity, party, kind) AS split_at, max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (PARTITION BY entity, party, kind) AS ever FROM split),
numbered AS (SELECT *, CASE WHEN kind = 'a' OR ever = 0 OR period < split_at THEN 0 WHEN twice THEN 100 + dense_rank() OVER (PARTITION BY entity, party, kind, period ORDER BY name) WHEN min(period) OVER (PARTITION BY entity, party, name) < split_at THEN 0 WHEN name LIKE 'PT. %' THEN 300 ELSE 400 END AS number FROM once),
first AS (SELECT entity, party, kind, number, min({{'period': period, 'name': name}}) AS x FROM numbered GROUP BY ALL),
ids AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY x.period, x.name) - 1 AS party_id FROM first)
SELECT n.entity, n.period, n.name, CAST(party_id AS BIGINT) AS party_id, kind = 'n' AND ever = 1 AND period >= split_at AS ambiguous FROM numbered n JOIN ids USING (entity, party, kind, number)""")
def k24(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("party"), F.col("n_name").alias("n"))
    month, two = F.month("period"), (F.col("party") % 5 == 0) & (F.month("period") == 7) & (F.year("period") == 1997)
    one = F.when(month % 3 == 0, F.concat(F.lit("PT. "), "n")).when(month % 3 == 1, F.concat("n", F.lit(" Tbk"))).otherwise(F.concat(F.lit("A/C "), "n"))
    both = F.array(F.concat(F.lit("PT "), "n"), F.concat("n", F.lit(" (PERSERO) TBK")))
    history = positions(spark, d).join(names, "party").select("entity", "period", F.explode(F.when(two, both).otherwise(F.array(one))).alias("name"))
    return I.assign_party_ids(history)


QUERIES = query.queries | plain.queries
SQL = query.sql | plain.sql
