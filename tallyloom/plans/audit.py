"""An audit cycle as one plan: signals, ambiguity, approvals and severity of all transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import AUDIT, AuditRules
from tallyloom.operators import control, severity
from tallyloom.session import cut
from tallyloom.sources.files import numbered


def audit(transactions: DataFrame, unmatched: DataFrame, duplicate_keys: list[str], approvals: DataFrame | None = None, ambiguous: DataFrame | None = None, rules: AuditRules = AUDIT) -> DataFrame:
    """Scored suspicious transactions, each id once.

    Suspicious: unmatched, incomplete, duplicate, or the source of an ambiguity that no gap resolves. ``approvals``:
    (txn_id) with an email approval.
    """
    once = severity.signals(transactions, unmatched, duplicate_keys, rules)
    if ambiguous is not None:
        open_ = severity.resolve_ambiguity(ambiguous, rules.gap).where("decision = 'escalate'").select(F.col("source_entity_id").alias("a_id")).distinct()
        once = once.join(open_, once["txn_id"] == open_["a_id"], "left").withColumn("is_ambiguous", F.col("a_id").isNotNull()).drop("a_id")
    else:
        once = once.withColumn("is_ambiguous", F.lit(False))
    chosen = once.where("is_unmatched OR is_incomplete OR is_duplicate OR is_ambiguous").dropDuplicates(["txn_id"])
    if approvals is not None:
        ok = approvals.select(F.col("txn_id").alias("ok_id")).distinct()
        chosen = chosen.join(ok, chosen["txn_id"] == ok["ok_id"], "left").withColumn("email_approval", F.col("ok_id").isNotNull()).drop("ok_id")
    else:
        chosen = chosen.withColumn("email_approval", F.lit(False))
    return severity.audit_severity(chosen, rules)


def audit_flags(scored: DataFrame, run_id: str, created_at: Column) -> DataFrame:
    return severity.flags(scored, run_id, created_at)


def lineage(flags: DataFrame, links: DataFrame, transactions: DataFrame) -> DataFrame:
    """Flag, its transaction and the records that the transaction is linked to."""
    live = links.where("is_current").select(F.col("source_id").alias("txn_id"), "link_id", F.col("target_id").alias("linked_id"), F.col("target_type").alias("linked_type"), "match_tier")
    return flags.join(transactions.select("txn_id", "source", "date"), "txn_id", "left").join(live, "txn_id", "left").select("flag_id", "txn_id", "source", "date", "link_id", "linked_id", "linked_type", "match_tier")


def lineage_edges(flags: DataFrame, links: DataFrame, transactions: DataFrame) -> DataFrame:
    """(from_id, to_id, kind): the graph around every flag, each edge once; flags are computed once and written.

    A source recorded the transaction, a tier matched it with a record, an audit flagged it, and the flag has its severity.
    Kinds are freed of repeated edges one by one, so that no task holds a transaction's edges for each of its links.
    """
    flagged = cut(flags.select("flag_id", "txn_id", "severity"))
    live = links.where("is_current").select(F.col("source_id").alias("txn_id"), "target_id", F.concat(F.lit("matched by "), F.col("match_tier")).alias("kind"))
    known = flagged.select("txn_id")

    def edges(rows: DataFrame, start: str, end: str, kind: Column) -> DataFrame:
        return rows.select(F.col(start).alias("from_id"), F.col(end).alias("to_id"), kind.alias("kind")).where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct()

    recorded = edges(transactions.select("txn_id", "source").join(known, "txn_id", "left_semi"), "source", "txn_id", F.lit("recorded"))
    matched = edges(live.join(known, "txn_id", "left_semi"), "txn_id", "target_id", F.col("kind"))
    return recorded.unionByName(matched).unionByName(edges(flagged, "txn_id", "flag_id", F.lit("flagged"))).unionByName(edges(flagged, "flag_id", "severity", F.lit("classified")))


def logged(scored: DataFrame, run_id: str, at: Column) -> DataFrame:
    """Audit-trail entries of an audit's decisions, one for each scored transaction, numbered by id."""
    entries = scored.select(
        F.lit(run_id).alias("audit_run_id"), F.lit("escalation").alias("agent_name"), F.lit("audit_severity").alias("tool_called"), at.alias("timestamp"),
        F.struct("txn_id", "vendor", "amount").alias("input_data"), F.struct("score", "severity").alias("output_summary"), F.col("factors").alias("decision_chain"),
    )
    return control.trail_entries(numbered(entries.withColumn("__id", F.col("input_data.txn_id")), ["__id"], "log_sequence_number", "%d"))


def alerts(metrics: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value, threshold, firing) of one metrics row; a rule is (``>`` or ``<``, threshold)."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), (F.col(m) > t if op == ">" else F.col(m) < t).alias("firing")) for m, (op, t) in rules.items()]
    return metrics.select(F.explode(F.array(*rows)).alias("a")).select("a.*")
