"""Registered queries on the checks of claims: claims, disclosures, mentions and holdings that Spark derives from the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.operators import verdicts as V
from filingflow.plans.desk import EVENTS, events, known
from filingflow.plans.registry import Registry

CHECKS = f"""{EVENTS},
claim AS (SELECT fid, code, day AS date, e % 6 AS k, u FROM ev WHERE kind <> 'K' OR e % 6 NOT IN (2, 3, 5)),
disclosure AS (SELECT code, day + CAST(e * 7 % 90 AS INTEGER) - 45 AS disclosed, CASE WHEN e % 3 = 0 THEN CASE WHEN e % 2 = 0 THEN 0 ELSE 1 END END AS carries, 'D' || e AS ref FROM ev WHERE t = 'click' AND e % 4 <> 0),
support AS (SELECT fid, code, min({{'gap': abs(disclosed - date), 'date': disclosed, 'ref': ref}}) FILTER (carries = k) AS support, min({{'gap': abs(disclosed - date), 'date': disclosed, 'ref': ref}}) AS other FROM claim JOIN disclosure USING (code) WHERE abs(disclosed - date) <= 45 GROUP BY ALL),
mention AS (SELECT fid, code, min({{'gap': abs(told - date), 'date': told, 'doc': doc, 'line': line}}) AS mention FROM claim JOIN (SELECT code, day + CAST(e * 13 % 400 AS INTEGER) - 200 AS told, 'm' || e AS doc, CAST(e % 9 AS INTEGER) AS line FROM ev WHERE t = 'signup' AND e % 2 = 0) USING (code) WHERE k = 1 AND abs(told - date) <= 180 GROUP BY ALL),
holder AS (SELECT fid, code, CAST(row_number() OVER (PARTITION BY fid ORDER BY h) AS INTEGER) AS place, h, CASE WHEN h = 0 THEN 'Rimau' || u || 'x Budi' ELSE 'Tanoko' || u || 'y Sari' END AS name,
  CASE WHEN h = 0 THEN CASE u % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END ELSE CASE WHEN u % 2 = 0 THEN 'up' ELSE 'down' END END AS direction, CASE WHEN code IN (SELECT code FROM ev WHERE u % 5 <> 0) THEN '2024-01' ELSE '2023-12' END AS ref, k, u, date FROM claim, (SELECT unnest([0, 1]) AS h) WHERE k = 5 OR (k = 2 AND h = 0) OR (k = 3 AND h = 1)),
held AS (SELECT *, CASE WHEN ref = '2024-01' AND strftime(date, '%Y-%m') <= ref AND ((k = 2 AND direction = 'up') OR (k = 3 AND direction = 'down')) THEN 'contradicted' ELSE 'recorded' END AS verdict FROM holder),
covered AS (SELECT DISTINCT day FROM ev WHERE day(day) % 7 NOT IN (3, 4)),
gap AS (SELECT CAST(g AS DATE) AS day FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS g FROM covered) WHERE isodow(g) < 6 AND CAST(g AS DATE) NOT IN (SELECT day FROM covered))"""
query = Registry(CHECKS)


def _tables(spark, d) -> dict:
    e = events(spark, d)
    k, u, lit = F.col("e") % 6, F.col("u"), F.lit
    said = F.when(k == 0, "kabar buyback besar").when(k == 1, "akuisisi segera").when(k == 2, F.concat(lit("Rimau"), u, lit("x menjual"))).when(k == 3, F.concat(lit("Tanoko"), u, lit("y membeli"))).when(k == 4, "pemegang saham baru")
    said = said.otherwise(F.concat(lit("Rimau"), u, lit("x dan Tanoko"), u, lit("y hadir")))
    shifted = lambda n, wide: F.date_add("day", (F.col("e") * n % wide - wide // 2).cast("int"))
    people = e.select("code", "u").distinct()
    first, second = F.concat(lit("Rimau"), u, lit("x Budi")), F.concat(lit("Tanoko"), u, lit("y Sari"))
    months = F.array(*(lit(m).cast("date") for m in ("2023-11-01", "2023-12-01", "2024-01-01")))
    each = people.select("code", "u", F.posexplode(months).alias("m", "period"))
    shares = lambda up, down: F.when(up, 10 + F.col("m") * 10).when(down, 30 - F.col("m") * 10).otherwise(10).cast("bigint")
    positions = each.select("code", first.alias("name"), "period", lit(5.0).alias("pct"), shares(u % 3 == 0, u % 3 == 1).alias("shares")).unionByName(each.select("code", second.alias("name"), "period", lit(5.0).alias("pct"), shares(u % 2 == 0, u % 2 == 1).alias("shares")))
    return {
        "claims": e.select("fid", "code", F.col("day").alias("date"), "kind", said.alias("text")),
        "codes": known(spark, d),
        "disclosures": e.where("t = 'click'").select("code", shifted(7, 90).alias("date"), F.when(F.col("e") % 4 == 0, "rutin").otherwise("baru").alias("status"), F.array(F.when(F.col("e") % 3 == 0, "aksi_korporasi").otherwise("hukum")).alias("categories"), F.when(F.col("e") % 2 == 0, "buyback saham").otherwise("akuisisi").alias("text"), F.concat(lit("D"), "e").alias("ref")),
        "mentions": e.where("t = 'signup'").select("code", shifted(13, 400).alias("date"), F.when(F.col("e") % 2 == 0, "transaksi_saham").otherwise("lain").alias("relation"), F.concat(lit("m"), "e").alias("doc"), (F.col("e") % 9).cast("int").alias("line")),
        "holders": people.select("code", lit(0).alias("place"), first.alias("name")).unionByName(people.select("code", lit(1).alias("place"), second.alias("name"))),
        "positions": positions,
        "usable": each.where("u % 5 <> 0 OR m < 2").select("code", "period"),
        "covered": e.where(~(F.dayofmonth("day") % 7).isin(3, 4)).select("day").distinct(),
    }


@query("L02_nearest_support", "SELECT fid, support.ref AS support, support.gap AS support_gap, other.ref AS other FROM support")
def l02(spark, d):
    t = _tables(spark, d)
    found = V.disclosure_support(V.eligible(t["claims"], t["codes"]), t["disclosures"])
    return found.select("fid", F.col("support.ref").alias("support"), F.col("support.gap").cast("bigint").alias("support_gap"), F.col("other.ref").alias("other"))


@query("L03_nearest_mention", "SELECT fid, mention.doc AS doc, mention.line AS line, mention.date AS date FROM mention")
def l03(spark, d):
    t = _tables(spark, d)
    return V.mention_support(V.eligible(t["claims"], t["codes"]), t["mentions"]).select("fid", "mention.doc", "mention.line", "mention.date")


@query("L04_named_parties", "SELECT fid, name FROM holder")
def l04(spark, d):
    t = _tables(spark, d)
    return V.named_holders(V.eligible(t["claims"], t["codes"]), t["holders"]).select("fid", "name")


@query("L05_trend_check", "SELECT fid, place, verdict, ref, name, direction FROM held")
def l05(spark, d):
    t = _tables(spark, d)
    c = V.eligible(t["claims"], t["codes"])
    return V.holder_verdicts(c, V.named_holders(c, t["holders"]), V.holder_trends(t["positions"], t["usable"])).select("fid", "place", "verdict", "ref", "name", "direction")


@query("L06_check_claims", """, every AS (
  SELECT fid, 0 AS a, 0 AS b, 'supported' AS verdict, 'disclosure' AS source, support.ref AS ref FROM support WHERE support IS NOT NULL
  UNION ALL SELECT fid, 1, 0, 'supported', 'mention', mention.doc || '#' || mention.line FROM mention
  UNION ALL SELECT fid, 2, place, verdict, 'holders', ref FROM held),
bare AS (SELECT c.*, s.other.ref AS other, (SELECT count(*) FROM gap WHERE abs(gap.day - c.date) <= 7) >= 2 OR c.date > (SELECT max(day) FROM covered) AS uncovered FROM claim c LEFT JOIN support s USING (fid) WHERE fid NOT IN (SELECT fid FROM every WHERE verdict = 'supported')),
full_list AS (SELECT * FROM every UNION ALL SELECT fid, 3, 0, 'other_topic', 'disclosure', other FROM bare WHERE other IS NOT NULL
  UNION ALL SELECT fid, 4, 0, CASE WHEN uncovered THEN 'not_checkable' ELSE 'no_basis' END, 'coverage', CAST(date AS VARCHAR) FROM bare WHERE k IN (0, 1) AND (uncovered OR other IS NULL)
  UNION ALL SELECT fid, 5, 0, 'not_checkable', 'coverage', '2024-01' FROM bare WHERE k = 4 AND strftime(date, '%Y-%m') > '2024-01')
SELECT fid, CAST(row_number() OVER (PARTITION BY fid ORDER BY a, b) AS INTEGER) AS place, verdict, source, ref FROM full_list QUALIFY row_number() OVER (PARTITION BY fid ORDER BY a, b) <= 4""")
def l06(spark, d):
    return V.check_claims(**_tables(spark, d)).select("fid", "place", "verdict", "source", "ref")


QUERIES, SQL = query.queries, query.sql
