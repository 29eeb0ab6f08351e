"""Reviewer feedback: the state machine over links, decisions, and tuning of rules."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import AUDIT, AuditRules
from tallyloom.functions import text as T
from tallyloom.operators import merge

# Reviewer decisions and the signals they stand for.
DECISIONS = {"approved": "confirmed", "rejected": "rejected", "false_positive": "rejected", "needs_more_info": "flagged"}


def signal_of(decision: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv]), decision)


@dataclass
class Processed:
    links: DataFrame
    unmatched: DataFrame
    feedback: DataFrame


def process(links: DataFrame, unmatched: DataFrame, feedback: DataFrame, at: Column, run_id: str = "") -> Processed:
    """Handle open feedback: a rejected link is closed and its source queued as unmatched again; all is marked processed.

    Feedback on a link that is gone is just marked.
    """
    rejected = feedback.where("NOT processed AND signal = 'rejected'").select("link_id").distinct()
    hit = links.where("is_current").join(rejected, "link_id", "left_semi")
    queued = hit.select(F.col("source_id").alias("entity_id"), F.col("source_type").alias("entity_type"), "target_type", F.lit("no_candidate_found").alias("reason_code"), F.lit(run_id).alias("run_id"), at.alias("created_at"))
    return Processed(merge.soft_delete(links, rejected, at), merge.upsert(unmatched, queued.dropDuplicates(["entity_id", "entity_type", "target_type"]), ["entity_id", "entity_type", "target_type"]), feedback.withColumn("processed", F.lit(True)))


def best_link(links: DataFrame) -> DataFrame:
    """(txn_id, link_id, confidence): of each transaction's current links the one of greatest confidence, then least id."""
    rows = links.where("is_current AND source_type = 'transaction'")
    best = F.min(F.struct(F.col("confidence").isNull().alias("none"), (-F.col("confidence")).alias("less"), "link_id", "confidence"))
    return rows.groupBy(F.col("source_id").alias("txn_id")).agg(best.alias("b")).select("txn_id", "b.link_id", "b.confidence")


def feedback_row(link_id: Column, signal: Column, source: Column, reason: Column, at: Column) -> list[Column]:
    return [T.stable_id(link_id, signal, source, at).alias("feedback_id"), link_id.alias("link_id"), signal.alias("signal"), source.alias("source"), F.substring(reason, 1, 1000).alias("reason"), at.alias("created_at"), F.lit(False).alias("processed")]


def confirmed(resolved: DataFrame, links: DataFrame, at: Column) -> DataFrame:
    """(feedback row): ``confirmed`` for each ambiguity that was resolved to a target with a current link.

    resolved: (source_entity_id, target_id, decision), as ``severity.resolve_ambiguity`` gives it.
    """
    chosen = resolved.where("decision = 'resolve'").select(F.col("source_entity_id").alias("source_id"), "target_id").distinct()
    live = links.where("is_current").select("source_id", "target_id", "link_id")
    return chosen.join(live, ["source_id", "target_id"]).select(*feedback_row(F.col("link_id"), F.lit("confirmed"), F.lit("autonomous"), F.concat(F.lit("resolved to "), F.col("target_id")), at))


def recent(flags: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Flags made after midnight ``days`` days before ``now``."""
    return flags.where(F.col("created_at") > F.date_sub(F.to_date(now), days))


def vendor_false_positives(flags: DataFrame, least: float = AUDIT.vendor_fp) -> DataFrame:
    """(vendor, flags, false_positives, fp_rate, whitelist); vendors without false positives are never selected."""
    n, fp = F.count("*"), F.count_if(F.col("human_decision") == "false_positive")
    return flags.groupBy("vendor").agg(n.alias("flags"), fp.alias("false_positives"), (fp / n).alias("fp_rate")).withColumn("whitelist", (F.col("false_positives") > 0) & (F.col("fp_rate") > least))


def rule_false_positives(flags: DataFrame, least: float = AUDIT.rule_fp) -> DataFrame:
    """(explanation, flags, false_positives, fp_rate, raise_sigma): noisy explanations that name the amount rule."""
    n, fp = F.count("*"), F.count_if(F.col("human_decision") == "false_positive")
    rows = flags.groupBy("explanation").agg(n.alias("flags"), fp.alias("false_positives"), (fp / n).alias("fp_rate"))
    return rows.withColumn("raise_sigma", (F.col("fp_rate") > least) & F.contains("explanation", F.lit("amount_outlier")))


def tuned(flags: DataFrame, rules: AuditRules = AUDIT, now: Column | None = None, days: int = 7) -> tuple[AuditRules, DataFrame]:
    """(rules, whitelist) after a review: the global sigma raised by half for each noisy amount rule, and the noisy vendors.

    now: judge the flags of the last ``days`` days before it; all flags if left out. The whitelist (vendor) is a table,
    with the vendors of the given rules among its rows; ``severity.whitelisted`` joins it, so neither the driver nor a
    plan grows with it. ``config.save_rules`` writes the rules.
    """
    flags = flags if now is None else recent(flags, now, days)
    noisy = vendor_false_positives(flags).where("whitelist").select("vendor")
    known = flags.sparkSession.createDataFrame([(v,) for v in rules.whitelisted], "vendor string")
    steps = rule_false_positives(flags).where("raise_sigma").count()
    return replace(rules, sigma_global=rules.sigma_global + 0.5 * steps), noisy.unionByName(known).distinct()


def feedback_metrics(feedback: DataFrame, now: Column) -> DataFrame:
    handled = F.count_if(F.col("signal").isNotNull())
    return feedback.agg(F.count("*").alias("handled"), F.count_if(F.col("signal") == "rejected").alias("rejected"), F.try_divide(F.count_if(F.col("signal") == "rejected"), handled).alias("rejection_rate"), F.avg(now.cast("double") - F.col("created_at").cast("timestamp").cast("double")).alias("mean_latency_s"))
