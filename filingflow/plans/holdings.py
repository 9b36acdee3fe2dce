"""Registered queries on holdings (A and K), with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.functions.names import is_pooled, party_key
from filingflow.operators import signals as K
from filingflow.operators import structure as A
from filingflow.operators.relational import asof_join, rank_pct, sum_strict
from filingflow.plans.registry import Registry
from filingflow.plans.tables import POSITIONS, pooled, positions, table

query = Registry(POSITIONS)
plain = Registry()
FIRST, SECOND = "1996-03-01", "1996-04-01"


STRUCTURE = """,
unit AS (SELECT entity, period, party, pct, CAST(round(pct * 1000000) AS BIGINT) AS u FROM positions),
sums AS (SELECT entity, period, count(*) AS n, CAST(sum(u) AS BIGINT) AS units, max(u) AS top_units, CAST(CAST(sum(u * u) AS BIGINT) AS DOUBLE) / 1e12::DOUBLE AS hhi, CAST(sum(CASE WHEN q.party IS NULL AND pct >= 1 AND pct < 5 THEN u ELSE 0 END) AS BIGINT) AS small
  FROM unit p LEFT JOIN pooled q ON p.party = q.party GROUP BY entity, period),
structure AS (SELECT entity, period, n, CAST(units AS DOUBLE) / 1000000.0::DOUBLE AS total, CAST(100000000 - units AS DOUBLE) / 1000000.0::DOUBLE AS rest, hhi, round(10000 / hhi, 4) AS effective_n, CAST(top_units AS DOUBLE) / 1000000.0::DOUBLE AS top, CAST(small AS DOUBLE) / 1000000.0::DOUBLE AS shadow,
  CAST(CASE WHEN n > 1 THEN (units - top_units) // (n - 1) END AS DOUBLE) / 1000000.0::DOUBLE AS avg_rest FROM sums)"""
COUNTS = """,
counts AS (SELECT entity, period, holders FROM (SELECT DISTINCT entity FROM positions) CROSS JOIN axis LEFT JOIN (SELECT entity, period, count(*) AS holders FROM positions GROUP BY ALL) USING (entity, period))"""
USABLE = """,
lists AS (SELECT entity, period, count(*) AS n, sum(pct) AS total, bool_and(pct >= 0 AND pct <= 100 AND coalesce(shares, 0) >= 0) AS ranges FROM positions GROUP BY ALL),
valid AS (SELECT entity, period, n, coalesce(ranges AND round(total, 4) <= 100.05 AND total >= 0, false) AS valid FROM (SELECT DISTINCT entity FROM positions) CROSS JOIN axis LEFT JOIN lists USING (entity, period)),
usable AS (SELECT entity, period, n, valid AND NOT coalesce(coalesce(lag(valid) OVER w, false) AND coalesce(lead(valid) OVER w, false) AND lag(n) OVER w >= 4 AND n < 0.6 * least(lag(n) OVER w, lead(n) OVER w), false) AS usable
  FROM valid WINDOW w AS (PARTITION BY entity ORDER BY period)),
ends AS (SELECT entity, min(period) AS begin, max(period) AS "end" FROM usable WHERE usable GROUP BY 1)"""
CHANGES = USABLE + """,
spans AS (SELECT * FROM (SELECT entity, period, usable, lead(period) OVER w AS next, lead(usable) OVER w AS nu FROM usable WINDOW w AS (PARTITION BY entity ORDER BY period)) WHERE usable AND nu),
changes AS (SELECT s.entity, s.next AS period, coalesce(a.party, b.party) AS party, coalesce(a.shares, 0) AS before, coalesce(b.shares, 0) AS after, coalesce(a.pct, 0.0) AS pct_before, coalesce(b.pct, 0.0) AS pct_after
  FROM spans s JOIN (SELECT DISTINCT party FROM positions) q ON true LEFT JOIN positions a ON a.entity = s.entity AND a.period = s.period AND a.party = q.party LEFT JOIN positions b ON b.entity = s.entity AND b.period = s.next AND b.party = q.party
  WHERE a.party IS NOT NULL OR b.party IS NOT NULL)"""
TRANSFERS = CHANGES + """,
sellers AS (SELECT entity, period, party AS seller, before - after AS sold, round(pct_before - pct_after, 6) AS points FROM changes WHERE round(pct_before - pct_after, 6) >= 1 AND after < before),
fit AS (SELECT s.*, party AS buyer, after - before AS bought, (after - before) = sold AS exact FROM sellers s JOIN changes c ON c.entity = s.entity AND c.period = s.period AND c.after > c.before WHERE 100 * (after - before) BETWEEN 97 * sold AND 103 * sold),
best AS (SELECT *, count(*) OVER (PARTITION BY entity, period, seller) AS candidates, row_number() OVER (PARTITION BY entity, period, seller ORDER BY abs(bought - sold), buyer) AS k FROM (SELECT *, bool_or(exact) OVER (PARTITION BY entity, period, seller) AS any_exact FROM fit) WHERE exact OR NOT any_exact),
transfers AS (SELECT entity, period, seller, buyer, sold, bought, points, candidates, CASE WHEN candidates > 1 THEN 'weak' WHEN exact AND sold % 100000 <> 0 THEN 'strong' ELSE 'medium' END AS tier FROM best WHERE k = 1)"""
SPLITS = TRANSFERS + """,
new_buyers AS (SELECT entity, period, count(*) AS buyers, CAST(sum(after) AS BIGINT) AS bought, bool_and(pct_after < 5) AS all_small FROM changes WHERE before = 0 AND after > 0 GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8),
splits AS (SELECT s.entity, s.period, s.seller, sold, buyers, bought, all_small, CASE WHEN sold = bought THEN 'strong' ELSE 'medium' END AS tier FROM sellers s JOIN new_buyers USING (entity, period) ANTI JOIN transfers t ON t.entity = s.entity AND t.period = s.period AND t.seller = s.seller WHERE 10 * bought BETWEEN 9 * sold AND 11 * sold)"""
INDEX = """,
party_index AS (SELECT party, entity, min(period) AS first, max(period) AS last, arg_min(pct, period) AS pct_first, arg_max(pct, period) AS pct_last, max(pct) AS pct_max FROM positions GROUP BY ALL)"""
PARTIES = SPLITS + INDEX + """,
around AS (SELECT entity, period, usable, lag(usable) OVER w AS before, lead(usable) OVER w AS next, max(period) OVER () AS "end" FROM usable WINDOW w AS (PARTITION BY entity ORDER BY period)),
open_index AS (SELECT * FROM party_index WHERE pct_last >= 2 AND party NOT IN (SELECT party FROM pooled)),
new_parties AS (SELECT i.entity, party, first, pct_last AS pct FROM open_index i JOIN around f ON f.entity = i.entity AND f.period = first AND f.usable AND f.before JOIN around l ON l.entity = i.entity AND l.period = last AND l.period = l."end" AND l.usable),
exited AS (SELECT i.entity, party, last, pct_last AS pct FROM open_index i JOIN around a ON a.entity = i.entity AND a.period = last AND a.usable AND a.next),
near AS (SELECT p.entity, party, p.period, pct FROM positions p JOIN around a ON p.entity = a.entity AND p.period = a.period AND a.period = a."end" AND a.usable WHERE pct >= 4.5 AND pct < 5 AND party NOT IN (SELECT party FROM pooled))"""
PAIRS = """,
held AS (SELECT DISTINCT party, entity FROM positions ANTI JOIN pooled USING (party)),
several AS (SELECT * FROM held WHERE party IN (SELECT party FROM held GROUP BY 1 HAVING count(*) >= 2)),
sized AS (SELECT * FROM several WHERE entity IN (SELECT entity FROM several GROUP BY 1 HAVING count(*) <= 60)),
pairs AS (SELECT x.party AS a, y.party AS b, count(*) AS entities FROM sized x JOIN sized y ON x.entity = y.entity AND x.party < y.party GROUP BY ALL HAVING count(*) >= 2)"""
COMPONENTS = """,
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b),
members AS (SELECT node AS party, min(root) AS cluster FROM reach GROUP BY 1),
clusters AS (SELECT party, cluster FROM members WHERE cluster IN (SELECT cluster FROM members GROUP BY 1 HAVING count(*) BETWEEN 3 AND 80))"""
CLUSTER_POSITIONS = """,
last_lists AS (SELECT p.* FROM positions p JOIN ends e ON p.entity = e.entity AND p.period = e."end"),
own AS (SELECT entity, cluster, count(*) AS n, round(sum(pct), 4) AS total, CAST(sum(CASE WHEN pct < 5 THEN 1 ELSE 0 END) AS BIGINT) AS small FROM last_lists JOIN clusters USING (party) GROUP BY ALL HAVING count(*) >= 3 AND round(sum(pct), 4) >= 5),
largest AS (SELECT own.entity, own.cluster, max(pct) AS largest_other FROM own JOIN last_lists l ON l.entity = own.entity LEFT JOIN clusters c ON c.party = l.party WHERE c.cluster IS DISTINCT FROM own.cluster GROUP BY ALL),
cluster_positions AS (SELECT own.*, largest_other, coalesce(total > largest_other, true) AS above FROM own LEFT JOIN largest USING (entity, cluster))"""
ALL_SIGNALS = PARTIES + PAIRS + COMPONENTS + CLUSTER_POSITIONS + """,
signals AS (SELECT entity, 'transfer' AS kind, tier, seller AS party, points, NULL::DOUBLE AS pct, NULL::INTEGER AS small FROM transfers UNION ALL SELECT entity, 'split', tier, seller, NULL, NULL, CAST(all_small AS INTEGER) FROM splits
  UNION ALL SELECT entity, 'new', 'fact', party, NULL, pct, NULL FROM new_parties UNION ALL SELECT entity, 'exit', 'fact', party, NULL, pct, NULL FROM exited UNION ALL SELECT entity, 'near5', 'fact', party, NULL, pct, NULL FROM near
  UNION ALL SELECT entity, 'cluster', 'medium', cluster, CASE WHEN above THEN 3.0 ELSE 0.0 END, total, CAST(small AS INTEGER) FROM cluster_positions)"""


class Holdings:
    """The frames that several queries share, built once a call."""

    def __init__(self, spark, d):
        self.positions, self.pooled = positions(spark, d), pooled(spark, d)
        self.axis = A.period_axis(self.positions, 5)

    @property
    def usable(self):
        return K.usable_periods(self.positions, self.axis)

    @property
    def changes(self):
        return K.changes(self.positions, self.usable)

    @property
    def pairs(self):
        return K.coholding_pairs(self.positions, self.pooled)

    def signals(self):
        # The holdings are a small aggregate that nine branches read: kept once instead of joined nine times.
        self.positions = self.positions.persist()
        usable, changes, index = self.usable.persist(), self.changes.persist(), K.party_index(self.positions)
        transfers = K.block_transfers(changes)
        cluster = K.cluster_positions(self.positions, K.clusters(self.pairs), usable)
        return K.signals(transfers, K.block_splits(changes, transfers), K.new_parties(index, usable, self.pooled), K.exited_parties(index, usable, self.pooled), K.near_threshold(self.positions, usable, self.pooled), cluster)


@query("A06_structure", STRUCTURE + "\nSELECT s.*, r.hhi_rank FROM structure s JOIN (SELECT entity, period, CAST(floor((200 * less + 100 * same + n) / (2 * n)) AS BIGINT) AS hhi_rank FROM (SELECT entity, period, count(*) OVER (PARTITION BY period) AS n, rank() OVER (PARTITION BY period ORDER BY hhi) - 1 AS less, count(*) OVER (PARTITION BY period, hhi) AS same FROM structure)) r USING (entity, period)")
def a06(spark, d):
    return A.with_percentile(A.structure(positions(spark, d), pooled(spark, d)), "hhi")


@query("A01_snapshot_issues", "SELECT entity, period, concat_ws(',', CASE WHEN count(*) <> count(DISTINCT party) THEN 'duplicate' END, CASE WHEN bool_or(pct < 0 OR pct > 100) THEN 'range' END, CASE WHEN bool_or(shares IS NULL OR shares < 0) THEN 'shares' END, CASE WHEN round(sum(pct), 4) > 100.05 THEN 'total' END) AS issues FROM positions GROUP BY ALL")
def a01(spark, d):
    return A.snapshot_issues(positions(spark, d))


REPORTS = """,
reports AS (SELECT entity, period, count(*) AS holders FROM positions GROUP BY ALL)"""


def _reports(spark, d):
    return positions(spark, d).groupBy("entity", "period").agg(F.count("*").alias("holders"))


PAIR = REPORTS + """,
pair AS (SELECT entity, max(CASE WHEN period <= DATE '1999-05-01' THEN period END) AS latest, coalesce(max(CASE WHEN period <= DATE '1997-02-01' THEN period END), min(CASE WHEN period > DATE '1997-02-01' AND period <= DATE '1999-05-01' THEN period END)) AS compared FROM reports GROUP BY 1)"""


@query("A02_report_pair", PAIR + "\nSELECT entity, latest, compared FROM pair")
def a02(spark, d):
    return A.report_pair(_reports(spark, d), "1997-02-01", "1999-05-01")


@query("A03_count_change", PAIR + "\nSELECT entity, compared, latest, a.holders AS holders_a, b.holders AS holders_b, b.holders - a.holders AS change FROM pair JOIN reports a USING (entity) JOIN reports b USING (entity) WHERE a.period = compared AND b.period = latest AND a.holders > 0 AND b.holders > 0")
def a03(spark, d):
    return A.count_change(_reports(spark, d), "1997-02-01", "1999-05-01")


def _ranked(mode, order):
    sql = STRUCTURE + f"""
SELECT entity, total_b, change, holders FROM (SELECT coalesce(a.entity, b.entity) AS entity, b.total AS total_b, CAST(CAST(round((b.total - a.total) * 1000000) AS BIGINT) AS DOUBLE) / 1000000.0::DOUBLE AS change, b.n - a.n AS holders FROM (SELECT * FROM structure WHERE period = DATE '{FIRST}') a FULL JOIN (SELECT * FROM structure WHERE period = DATE '{SECOND}') b USING (entity)) ORDER BY {order}, entity LIMIT 100"""

    @query(f"A04_rank_{mode}", sql)
    def a04(spark, d):
        return A.rank_changes(A.structure(positions(spark, d), pooled(spark, d)), FIRST, SECOND, mode)


for _mode, _order in (("largest", "total_b DESC NULLS LAST"), ("up", "change DESC NULLS LAST"), ("down", "change ASC NULLS LAST"), ("holders_up", "holders DESC NULLS LAST"), ("holders_down", "holders ASC NULLS LAST"), ("code", "entity")):
    _ranked(_mode, _order)


@query("A05_diff_periods", f"SELECT entity, party, a.shares AS shares_a, b.shares AS shares_b, b.shares - a.shares AS change, round(b.pct - a.pct, 4) AS points, CASE WHEN a.pct IS NULL THEN 'new' WHEN b.pct IS NULL THEN 'gone' ELSE 'both' END AS status FROM (SELECT * FROM positions WHERE period = DATE '{FIRST}') a FULL JOIN (SELECT * FROM positions WHERE period = DATE '{SECOND}') b USING (entity, party)")
def a05(spark, d):
    return A.diff_periods(positions(spark, d), FIRST, SECOND)


IMPLIED = """,
implied AS (SELECT entity, period, list_sort(list(round(shares / pct * 100, 2)))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS implied FROM positions WHERE pct > 0 AND shares > 0 GROUP BY ALL)"""


@query("A07_implied_total", IMPLIED + "\nSELECT * FROM implied")
def a07(spark, d):
    return A.implied_total(positions(spark, d))


@query("A08_recent_valid", COUNTS + "\nSELECT entity, period, last_value(holders IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS holders FROM counts")
def a08(spark, d):
    p = positions(spark, d)
    return A.recent_valid(A.party_counts(p, A.period_axis(p, 5)), 2)


@query("A09_breadth", COUNTS + "\nSELECT entity, period, holders, " + ", ".join(f"holders - lag(holders, {k}) OVER w AS change_{k}" for k in (1, 3, 6, 12)) + " FROM counts WINDOW w AS (PARTITION BY entity ORDER BY period)")
def a09(spark, d):
    p = positions(spark, d)
    return A.breadth(A.party_counts(p, A.period_axis(p, 5)), [1, 3, 6, 12])


@query("A10_rank_pct", "SELECT entity, party, period, pct, CAST(floor((200 * less + 100 * same + n) / (2 * n)) AS BIGINT) AS standing FROM (SELECT entity, party, period, pct, count(*) OVER (PARTITION BY period) AS n, rank() OVER (PARTITION BY period ORDER BY pct) - 1 AS less, count(*) OVER (PARTITION BY period, pct) AS same FROM positions)")
def a10(spark, d):
    return rank_pct(positions(spark, d).select("entity", "party", "period", "pct"), "pct", ["period"], "standing").select("entity", "party", "period", "pct", "standing")


@query("A11_flow", IMPLIED + f""",
a AS (SELECT * FROM positions WHERE period = DATE '{FIRST}'), b AS (SELECT * FROM positions WHERE period = DATE '{SECOND}'),
gain AS (SELECT entity, sum(b.shares - a.shares) AS gain FROM a JOIN b USING (entity, party) ANTI JOIN pooled USING (party) GROUP BY 1),
f AS (SELECT entity, round(100 * gain / implied, 4) AS block, round(100.0::DOUBLE * (n_b - n_a) / n_a, 4) AS holders FROM gain JOIN (SELECT entity, implied FROM implied WHERE period = DATE '{SECOND}') USING (entity) JOIN (SELECT entity, count(*) AS n_a FROM a GROUP BY 1) USING (entity) JOIN (SELECT entity, count(*) AS n_b FROM b GROUP BY 1) USING (entity))
SELECT entity, block, holders, CASE WHEN block >= 1 AND holders <= -5 THEN 'accumulation' WHEN block <= -1 AND holders >= 5 THEN 'distribution' ELSE 'neutral' END AS kind FROM f""")
def a11(spark, d):
    return A.flow(positions(spark, d), pooled(spark, d), FIRST, SECOND)


def _prices(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("close"))


@plain("A15_asof_price", """SELECT s.s_suppkey, s.day, CASE WHEN date_diff('day', p.day, s.day) <= 7 THEN p.close END AS close, CASE WHEN date_diff('day', p.day, s.day) <= 7 THEN p.day END AS close_date
FROM (SELECT s_suppkey, s_nationkey AS code, CAST(unnest(generate_series(DATE '1995-01-01', DATE '1998-12-31', INTERVAL 1 MONTH)) AS DATE) AS day FROM supplier) s
ASOF LEFT JOIN (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS close FROM orders GROUP BY ALL) p ON s.code = p.code AND s.day >= p.day""")
def a15(spark, d):
    days = F.explode(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: F.add_months(F.lit("1995-01-01").cast("date"), k)))
    left = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("code"), days.alias("day"))
    return asof_join(left, _prices(spark, d), ["code"], "day", "day", "close", 7).select("s_suppkey", "day", "close", "close_date")


@plain("K01_party_key", """WITH n AS (SELECT c_custkey, (['The ', '', 'PT. '])[CAST(c_custkey % 3 AS INTEGER) + 1] || c_name || ([' Co.', ', Ltd', ' (Perseroan Terbatas) Tbk', ' & Sons', ''])[CAST(c_custkey % 5 AS INTEGER) + 1] AS name FROM customer)
SELECT c_custkey, list_aggregate(list_sort(list_filter(string_split(regexp_replace(regexp_replace(upper(name), '[^A-Z0-9 ]', ' ', 'g'), '\\b(PT|TBK|PERSEROAN TERBATAS|THE|LTD|LIMITED|INC|CORP|CORPORATION|PTE|CO|LLC|SA|AG|BV|NV|PERSERO)\\b', ' ', 'g'), ' '), lambda w: w <> '')), 'string_agg', ' ') AS key FROM n""")
def k01(spark, d):
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("c_custkey") % n).cast("int"))
    name = F.concat(pick(["The ", "", "PT. "], 3), "c_name", pick([" Co.", ", Ltd", " (Perseroan Terbatas) Tbk", " & Sons", ""], 5))
    return table(spark, d, "customer").select("c_custkey", party_key(name).alias("key"))


@plain("K02_is_pooled", """WITH n AS (SELECT s_suppkey, (['CITIBANK SINGAPORE S/A ', 'ABC NOMINEES ', 'Qq ', 'Plain ', 'THE BANK OF NEW YORK MELLON ', 'UBSX ', 'Clientship '])[CAST(s_suppkey % 7 AS INTEGER) + 1] || s_name AS name, (['Bank', 'Individual', 'Corporate', 'Pension Fund'])[CAST(s_suppkey % 4 AS INTEGER) + 1] AS cls FROM supplier)
SELECT s_suppkey, s_suppkey % 7 IN (0, 1, 2, 4) OR cls IN ('Bank', 'Pension Fund') AS pooled FROM n""")
def k02(spark, d):
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("s_suppkey") % n).cast("int"))
    named = table(spark, d, "supplier").select("s_suppkey", F.concat(pick(["CITIBANK SINGAPORE S/A ", "ABC NOMINEES ", "Qq ", "Plain ", "THE BANK OF NEW YORK MELLON ", "UBSX ", "Clientship "], 7), "s_name").alias("name"), pick(["Bank", "Individual", "Corporate", "Pension Fund"], 4).alias("cls"))
    return named.select("s_suppkey", is_pooled("name", "cls").alias("pooled"))


@query("K03_usable_periods", USABLE + "\nSELECT entity, period, n, usable FROM usable")
def k03(spark, d):
    return Holdings(spark, d).usable


@query("K05_block_transfers", TRANSFERS + "\nSELECT * FROM transfers")
def k05(spark, d):
    return K.block_transfers(Holdings(spark, d).changes)


@query("K06_block_splits", SPLITS + "\nSELECT * FROM splits")
def k06(spark, d):
    c = Holdings(spark, d).changes
    return K.block_splits(c, K.block_transfers(c))


@query("K07_new_parties", PARTIES + "\nSELECT * FROM new_parties")
def k07(spark, d):
    h = Holdings(spark, d)
    return K.new_parties(K.party_index(h.positions), h.usable, h.pooled)


@query("K08_exited_parties", PARTIES + "\nSELECT * FROM exited")
def k08(spark, d):
    h = Holdings(spark, d)
    return K.exited_parties(K.party_index(h.positions), h.usable, h.pooled)


@query("K09_near_threshold", USABLE + """,
around AS (SELECT entity, period, usable, max(period) OVER () AS "end" FROM usable)
SELECT p.entity, party, p.period, pct FROM positions p JOIN around a ON p.entity = a.entity AND p.period = a.period AND a.period = a."end" AND a.usable WHERE pct >= 2 AND pct < 60 AND party NOT IN (SELECT party FROM pooled)""")
def k09(spark, d):
    h = Holdings(spark, d)
    return K.near_threshold(h.positions, h.usable, h.pooled, 2.0, 60.0)


@query("K11_renames", CHANGES + """
SELECT period, old, new, entities, CASE WHEN entities >= 3 THEN 'strong' ELSE 'medium' END AS tier FROM (SELECT g.period, g.party AS old, c.party AS new, count(DISTINCT g.entity) AS entities FROM changes g JOIN changes c ON g.entity = c.entity AND g.period = c.period AND g.before = c.after AND g.party <> c.party
WHERE g.before > 0 AND g.after = 0 AND c.before = 0 AND c.after > 0 AND g.party NOT IN (SELECT party FROM pooled) AND c.party NOT IN (SELECT party FROM pooled) GROUP BY ALL HAVING count(DISTINCT g.entity) >= 2)""")
def k11(spark, d):
    h = Holdings(spark, d)
    return K.renames(h.changes, h.pooled)


@query("K12_coholding_pairs", PAIRS + "\nSELECT * FROM pairs")
def k12(spark, d):
    return Holdings(spark, d).pairs


@query("K13_clusters", PAIRS + COMPONENTS + "\nSELECT * FROM clusters")
def k13(spark, d):
    return K.clusters(Holdings(spark, d).pairs)


@query("K14_cluster_positions", USABLE + PAIRS + COMPONENTS + CLUSTER_POSITIONS + "\nSELECT * FROM cluster_positions")
def k14(spark, d):
    h = Holdings(spark, d)
    return K.cluster_positions(h.positions, K.clusters(h.pairs), h.usable)


@query("K15_party_index", INDEX + "\nSELECT * FROM party_index")
def k15(spark, d):
    return K.party_index(positions(spark, d))


BY_SCORE = ALL_SIGNALS + """,
scored AS (SELECT *, CASE kind WHEN 'transfer' THEN 3.0 WHEN 'split' THEN 5.0 WHEN 'cluster' THEN 2.0 ELSE 1.0 END + CASE kind WHEN 'transfer' THEN CASE WHEN tier = 'strong' THEN 2.0 ELSE 0.0 END + least(3.0, points / 5) WHEN 'split' THEN CASE WHEN small = 1 THEN 3.0 ELSE 0.0 END WHEN 'new' THEN least(3.0, pct / 5) WHEN 'exit' THEN CASE WHEN pct >= 5 THEN 1.0 ELSE 0.0 END
  WHEN 'cluster' THEN least(4.0, pct / 8) + points + least(2.0, small / 3) ELSE 0.0 END AS score FROM signals),
by_kind AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(s, 4) DESC, kind) AS r FROM (SELECT entity, kind, sum(score) AS s, count(*) AS n FROM scored GROUP BY ALL))
SELECT entity, round(sum(s), 1) AS score, CAST(sum(n) AS BIGINT) AS signals, max(CASE WHEN r = 1 THEN kind END) AS reason1, max(CASE WHEN r = 2 THEN kind END) AS reason2 FROM by_kind GROUP BY 1 ORDER BY score DESC, entity LIMIT 50"""


@query("K16_leaderboard", BY_SCORE)
def k16(spark, d):
    return K.leaderboard(Holdings(spark, d).signals())


MARKED = USABLE + """,
marked AS (SELECT p.entity, party, p.period, CASE WHEN usable THEN pct END AS pct FROM positions p JOIN usable u ON p.entity = u.entity AND p.period = u.period),
largest15 AS (SELECT entity, party FROM (SELECT entity, party, row_number() OVER (PARTITION BY entity ORDER BY most DESC NULLS LAST, party) AS k FROM (SELECT entity, party, max(pct) AS most FROM marked GROUP BY entity, party)) WHERE k <= 15)"""


@query("K17_history", MARKED + "\nSELECT m.* FROM marked m JOIN largest15 USING (entity, party)")
def k17(spark, d):
    h = Holdings(spark, d)
    return K.history(h.positions, h.usable)


TOP = ALL_SIGNALS + """,
top AS (SELECT * FROM (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY CASE tier WHEN 'strong' THEN 3 ELSE 2 END DESC, CASE kind WHEN 'split' THEN 6 WHEN 'transfer' THEN 5 ELSE 4 END DESC, coalesce(pct, points) DESC NULLS LAST, party) AS place, kind, tier, party FROM signals WHERE tier IN ('strong', 'medium')) WHERE place <= 6)"""


@query("K18_top_signals", TOP + "\nSELECT entity, place, kind, tier, party FROM top")
def k18(spark, d):
    return K.top_signals(Holdings(spark, d).signals())


@query("K19_second_hop", TOP + "\nSELECT f.entity AS from_entity, party, i.entity, pct_last FROM (SELECT DISTINCT entity, party FROM top WHERE kind <> 'cluster') f JOIN party_index i USING (party) WHERE i.entity <> f.entity")
def k19(spark, d):
    h = Holdings(spark, d)
    return K.second_hop(K.top_signals(h.signals()), K.party_index(h.positions))


@query("K21_latest_holders", "SELECT entity, party, period, shares, pct FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY pct DESC, party) AS k FROM (SELECT p.* FROM positions p JOIN (SELECT entity, max(period) AS period FROM positions GROUP BY 1) USING (entity, period))) WHERE k <= 25")
def k21(spark, d):
    return A.latest_holders(positions(spark, d), 25).select("entity", "party", "period", "shares", "pct")


@query("E05_top_parties", "SELECT entity, party, period, shares, pct FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY pct DESC, party) AS k FROM (SELECT p.* FROM positions p JOIN (SELECT entity, max(period) AS period FROM positions GROUP BY 1) USING (entity, period))) WHERE k <= 6")
def e05(spark, d):
    return A.latest_holders(positions(spark, d), 6).select("entity", "party", "period", "shares", "pct")


@query("K22_find_party", "SELECT party, n_name AS name, count(DISTINCT entity) AS entities FROM positions JOIN nation ON n_nationkey = party WHERE contains(upper(n_name), '1') GROUP BY ALL ORDER BY entities DESC, name LIMIT 40")
def k22(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("party"), F.col("n_name").alias("name"))
    return K.find_party(positions(spark, d), names, ["1"])


@plain("K23_sum_strict", "SELECT l_suppkey, CASE WHEN count(CASE WHEN l_discount > 0 THEN l_quantity END) = count(*) THEN CAST(sum(l_quantity) AS BIGINT) END AS shares FROM lineitem GROUP BY 1")
def k23(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("q"))
    return lines.groupBy("l_suppkey").agg(sum_strict("q").cast("bigint").alias("shares"))


@query("D19_period_axis", "SELECT period FROM axis")
def d19(spark, d):
    return A.period_axis(positions(spark, d), 5)


QUERIES = query.queries | plain.queries
SQL = query.sql | plain.sql
