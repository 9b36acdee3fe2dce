"""Tables of the driver as the operators see them, with the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings: entity = brand, party = nation of the customer, period = month of the order, shares = quantity; percent of the
    entity's total in whole millionths, so that every engine has the same numbers."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = t("orders").select("o_orderkey", "o_custkey", F.trunc("o_orderdate", "month").alias("period"))
    # Orders meet their customers first, so that the lines, of which there are most, are sent twice only.
    owners = orders.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("party")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "period", "party")
    joined = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", F.col("p_brand").alias("entity")), F.col("l_partkey") == F.col("p_partkey"))
    shares = joined.groupBy("entity", "party", "period").agg(F.sum("l_quantity").cast("bigint").alias("shares"))
    total = shares.groupBy("entity", "period").agg(F.sum("shares").alias("total"))
    return shares.join(total, ["entity", "period"]).select("entity", "party", "period", "shares", (F.floor((200000000 * F.col("shares") + F.col("total")) / (2 * F.col("total"))) / 1000000.0).alias("pct"))


POSITIONS = """shares_of AS (SELECT p_brand AS entity, c_nationkey AS party, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(l_quantity) AS BIGINT) AS shares
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
positions AS (SELECT entity, party, period, shares, CAST((200000000 * shares + total) // (2 * total) AS DOUBLE) / 1000000.0 AS pct
  FROM shares_of JOIN (SELECT entity, period, CAST(sum(shares) AS BIGINT) AS total FROM shares_of GROUP BY ALL) USING (entity, period)),
pooled AS (SELECT CAST(n_nationkey AS INTEGER) AS party FROM nation WHERE n_regionkey = 4),
axis AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT min(period) AS a, max(period) AS b FROM (SELECT period, count(DISTINCT entity) AS n FROM positions GROUP BY 1) WHERE n >= 5))"""


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties taken as custodians: the nations of one region."""
    return table(spark, sf_dir, "nation").where("n_regionkey = 4").select(F.col("n_nationkey").cast("int").alias("party"))


def catalog(spark: SparkSession, sf_dir: str, days: int | None = 30) -> DataFrame:
    """Orders as documents: a span from the order to its last shipment, of so many days at most (None: whole), priority as category."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.to_date(F.max("l_shipdate")).alias("last"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("start"), F.col("o_orderpriority").alias("cat"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("cust"))
    return o.join(lines, "doc_id").select("doc_id", "cat", "state", "cust", "start", F.greatest("start", "last" if days is None else F.least("last", F.date_add("start", days))).alias("end"))


CATALOG = """catalog AS (SELECT o_orderkey AS doc_id, o_orderpriority AS cat, o_orderstatus AS state, o_custkey AS cust, CAST(o_orderdate AS DATE) AS "start",
  greatest(CAST(o_orderdate AS DATE), least(last, CAST(o_orderdate AS DATE) + 30)) AS "end" FROM orders JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
