"""Queries of what the contract's documents specify for escalation and reconciliation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import anomaly, escalation, reconcile, severity
from tallyloom.plans import audit as A
from tallyloom.plans import canonical as C
from tallyloom.plans.queries import _SIGNALS, ORACLES, query
from tallyloom.plans.services import _KEPT, _scored

_RECEIPTS = f"""{C.GOLD}, rc AS (SELECT DISTINCT amount * 1.01 AS ra, date + 2 AS rd FROM gold WHERE pos % 5 = 0 AND amount IS NOT NULL AND date IS NOT NULL),
    got AS (SELECT DISTINCT txn_id FROM gold JOIN rc ON gold.date BETWEEN rc.rd - 7 AND rc.rd + 7 AND gold.amount BETWEEN ra * 0.95 AND ra * 1.05)"""
_CONTEXT = f"""{_RECEIPTS}, ctx AS (SELECT gold.*, pos % 4 = 0 AS un, 30 * (pos % 2 = 0)::int + 30 * (pos % 3 = 0)::int + 20 * (pos % 5 = 0)::int + 20 * (pos % 7 = 0)::int AS an, pos % 9 = 0 AS ap, got.txn_id IS NOT NULL AS re FROM gold LEFT JOIN got USING (txn_id)),
    sv AS (SELECT *, 40 * un::int + 30 * (an > 70)::int + 20 * (NOT ap)::int + 10 * (NOT re)::int AS score, list_filter([CASE WHEN un THEN 'No matching bank transaction found' END, CASE WHEN an > 70 THEN 'Anomaly score ' || an END, CASE WHEN NOT ap THEN 'No email approval located' END, CASE WHEN NOT re THEN 'Receipt not found' END], lambda x: x IS NOT NULL) AS why FROM ctx)"""
_LEVEL = "CASE WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 50 THEN 'WARNING' ELSE 'INFO' END"


def _receipts(spark: SparkSession, sf: str) -> DataFrame:
    """A receipt for every fifth order, two days later and a hundredth dearer."""
    return C.gold(spark, sf).where("pos % 5 = 0 AND amount IS NOT NULL AND date IS NOT NULL").selectExpr("concat('R', pos) AS receipt_id", "vendor", "amount * 1.01 AS amount", "date_add(date, 2) AS date")


def _context(spark: SparkSession, sf: str) -> DataFrame:
    signals = {"is_anomaly_if": 2, "is_vendor_outlier": 3, "is_amount_outlier": 5, "is_time_series_deviation": 7, "is_unmatched": 4, "email_approval": 9}
    g = anomaly.combined_score(C.gold(spark, sf).withColumns({c: F.col("pos") % n == 0 for c, n in signals.items()}))
    return escalation.contextual_severity(reconcile.with_receipt(g, _receipts(spark, sf)))


@query(f"""WITH {_CONTEXT} SELECT txn_id, score, {_LEVEL} AS severity, CASE WHEN len(why) > 0 THEN 'Flagged because: ' || array_to_string(list_transform(why, lambda x, i: '(' || i || ') ' || x), ', ') || '.' END AS explanation FROM sv""")
def r2_contextual_severity(spark, sf):
    """Severity from the findings of reconciliation, anomalies, approvals and receipts."""
    return _context(spark, sf).select("txn_id", "score", "severity", "explanation")


@query(f"""WITH {_CONTEXT}, m AS (SELECT vendor, avg(amount) AS usual FROM gold WHERE vendor IS NOT NULL AND amount IS NOT NULL AND date IS NOT NULL GROUP BY vendor HAVING count(DISTINCT date_trunc('month', date)) >= 3),
    l AS (SELECT txn_id, {_LEVEL} AS level, coalesce(abs(amount - usual) / abs(usual) * 100 < 5, false) AS near FROM sv LEFT JOIN m USING (vendor))
    SELECT txn_id, near AS is_settled, CASE WHEN near AND level = 'CRITICAL' THEN 'WARNING' WHEN near AND level = 'WARNING' THEN 'INFO' ELSE level END AS severity FROM l""")
def r3_recurring_vendors(spark, sf):
    """The same, a level lower where a recurring vendor asks for about what it always does."""
    return escalation.settled(_context(spark, sf), C.gold(spark, sf)).select("txn_id", "is_settled", "severity")


@query(f"""WITH {_CONTEXT}, n AS (SELECT txn_id, score, (row_number() OVER (ORDER BY txn_id) - 1) // 100 AS batch FROM sv WHERE score BETWEEN 40 AND 60)
    SELECT batch, count(*)::int AS n, string_agg(txn_id || ':' || score, ',' ORDER BY txn_id) AS rows FROM n GROUP BY batch""")
def r2_uncertain_batches(spark, sf):
    """Rows of which the rules are uncertain, in batches of a hundred."""
    out = escalation.uncertain(_context(spark, sf).select("txn_id", "score"), ["txn_id"])
    return out.select("batch", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: F.concat(r["txn_id"], F.lit(":"), r["score"].cast("string"))), ",").alias("rows"))


@query(f"""WITH {_RECEIPTS} SELECT txn_id, vendor FROM gold WHERE amount IS NOT NULL AND date < (SELECT max(date) FROM gold) - 7 AND coalesce(vendor NOT IN ('Vendor 1', 'Vendor 2'), true) AND txn_id NOT IN (SELECT txn_id FROM got)""")
def r2_missing_receipts(spark, sf):
    """Transactions a week and more before the last one that no receipt fits; two vendors give none."""
    g = C.gold(spark, sf)
    last = g.agg(F.max("date").alias("__now"))  # one row
    exempt = spark.createDataFrame([("Vendor 1",), ("Vendor 2",)], "vendor string")
    return escalation.missing_receipts(g.crossJoin(F.broadcast(last)), _receipts(spark, sf), F.col("__now"), exempt).select("txn_id", "vendor")


@query(f"""SELECT source_1_id, source_2_id, p.confidence, array_to_string(list_filter([CASE WHEN a.value <> b.value THEN 'amount mismatch' END, CASE WHEN abs(floor((epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0)) <> 0 THEN 'date mismatch' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM ({ORACLES["j8_cross_source"]}) p JOIN events a ON 'E' || a.event_id = source_1_id JOIN events b ON 'E' || b.event_id = source_2_id WHERE p.confidence < 0.9""")
def j8_low_confidence(spark, sf):
    """Cross-source pairs that ask for a closer look, with what differs."""
    one, two = C.event_sides(spark, sf)
    return reconcile.low_confidence(reconcile.cross_source(one, two), one, two).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {C.LINKS}, {_SIGNALS}, f AS (SELECT sha256('audit' || chr(31) || txn_id) AS flag_id, txn_id, pos, source, {_LEVEL} AS severity FROM sc WHERE {_KEPT})
    SELECT source AS from_id, txn_id AS to_id, 'recorded' AS kind FROM f UNION SELECT txn_id, flag_id, 'flagged' FROM f UNION SELECT flag_id, severity, 'classified' FROM f
    UNION SELECT txn_id, target_id, 'matched by ' || match_tier FROM f JOIN cur ON cur.k = f.pos WHERE is_current""")
def r12_lineage_edges(spark, sf):
    """The graph around every flag of an audit."""
    cur, _ = C.links(spark, sf)
    flagged = severity.flags(_scored(spark, sf), "audit", F.lit("2024-03-01").cast("timestamp"))
    return A.lineage_edges(flagged, cur.withColumn("source_id", F.concat(F.lit("T"), F.col("source_id").substr(2, 20))), C.gold(spark, sf))
