"""Scoring of suspicious transactions: signals, severity, explanations and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import AUDIT, AuditRules
from tallyloom.functions import text as T
from tallyloom.operators.feedback import best_link, feedback_row


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _level(score: Column, rules: AuditRules) -> Column:
    return F.when(score >= rules.critical, F.lit("CRITICAL")).when(score >= rules.warning, F.lit("WARNING")).otherwise(F.lit("INFO"))


def tool_severity(df: DataFrame, rules: AuditRules = AUDIT) -> DataFrame:
    """Tool form: unmatched 50, incomplete 30, amount above the tool's limit 20; confidence by the number of factors."""
    tests = [(_flag("is_unmatched"), 50, "no_reconciliation_match"), (_flag("is_incomplete"), 30, "incomplete_data"), (F.coalesce(F.col("amount") > rules.tool_high_amount, F.lit(False)), 20, "high_amount")]
    factors = F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, _, n in tests]))
    score = sum((F.when(t, w).otherwise(0) for t, w, _ in tests), F.lit(0))
    return df.withColumns({"score": score, "factors": factors}).withColumns({"severity": _level(F.col("score"), rules), "confidence": F.round(F.least(F.size("factors") / 3, F.lit(1.0)), 2)})


def whitelisted(df: DataFrame, whitelist: DataFrame, vendor: str = "vendor") -> DataFrame:
    """Add is_whitelisted by a join with a whitelist (vendor) of any size."""
    names = whitelist.select(F.col("vendor").alias("__listed")).distinct()
    return df.join(names, F.col(vendor) == F.col("__listed"), "left").withColumn("is_whitelisted", F.col("__listed").isNotNull()).drop("__listed")


def _listed(vendor: Column, rules: AuditRules) -> Column:
    return vendor.isin(*rules.whitelisted) if rules.whitelisted else F.lit(False)


def escalated(severity: Column, amount: Column, vendor: Column, rules: AuditRules = AUDIT, listed: Column | None = None) -> Column:
    """Critical above 1000 stays; a whitelisted vendor's warning is information; small information is approved.

    listed: as ``whitelisted`` gives it, in place of the vendors of the rules.
    """
    listed = _listed(vendor, rules) if listed is None else listed
    return F.when((severity == "CRITICAL") & (amount > 1000), severity).when((severity == "WARNING") & listed, F.lit("INFO")).when((severity == "INFO") & (amount < rules.approve_below), F.lit("AUTO_APPROVED")).otherwise(severity)


def audit_severity(df: DataFrame, rules: AuditRules = AUDIT) -> DataFrame:
    """Orchestrator form over is_unmatched, is_incomplete, is_duplicate, email_approval, amount and vendor.

    is_whitelisted, where ``df`` has it (see ``whitelisted``), takes the place of the vendors of the rules.

    Rows without a factor, with nothing but a missing match below the high amount, or approved by their size are gone.
    """
    vendor, amount = F.coalesce(F.when(F.col("vendor") != "", F.col("vendor")), F.lit("Unknown")), F.coalesce("amount", F.lit(0.0))
    money = F.concat(F.lit("$"), amount.cast("string"))
    texts = [
        (_flag("is_unmatched"), 50, "no_reconciliation_match", F.concat(F.lit("No matching bank transaction found for "), money, F.lit(" to "), vendor)),
        (_flag("is_incomplete"), 30, "incomplete_data", F.concat(F.lit("Transaction "), F.col("txn_id"), F.lit(" is missing required fields"))),
        (_flag("is_duplicate"), 40, "duplicate_transaction", F.concat(F.lit("Transaction "), F.col("txn_id"), F.lit(" appears to be a duplicate"))),
        (amount >= rules.high_amount, 20, "high_amount", F.concat(F.lit("Transaction amount "), money, F.lit(" exceeds high-value threshold"))),
        (_flag("email_approval"), -20, "email_approval_found", F.lit("email_approval_found")),
    ]
    score = sum((F.when(t, w).otherwise(0) for t, w, _, _ in texts), F.lit(0))
    factors = F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, _, n, _ in texts]))
    reasons = F.array_compact(F.array(*[F.when(t, x) for t, _, _, x in texts]))
    out = df.withColumns({"score": score, "factors": factors, "explanation": F.concat(F.lit("Flagged because: "), F.array_join(reasons, "; "), F.lit("."))})
    alone = (F.size("factors") == 1) & (F.col("factors")[0] == "no_reconciliation_match") & (amount < rules.high_amount)
    listed = _flag("is_whitelisted") if "is_whitelisted" in df.columns else _listed(vendor, rules)
    level = _level(F.col("score"), rules)
    out = out.where((F.size("factors") > 0) & ~alone).withColumn("severity", F.when((level == "WARNING") & listed, F.lit("INFO")).otherwise(level))
    return out.where(~((F.col("severity") == "INFO") & (amount < rules.approve_below)))


def signals(transactions: DataFrame, unmatched: DataFrame, duplicate_keys: list[str], rules: AuditRules = AUDIT) -> DataFrame:
    """Transactions with is_unmatched (by id, or a high amount), is_incomplete and is_duplicate (their id or key occurs twice).

    A key with a null doesn't make a duplicate; an id that occurs in several rows always does.
    """
    repeated = transactions.groupBy("txn_id").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("txn_id").alias("r_id"))
    gone = unmatched.select(F.col("txn_id").alias("u_id")).distinct()
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("vendor", "amount", "date")])
    twice = transactions.groupBy(*duplicate_keys).agg(F.count("*").alias("__n")).where("__n > 1")
    twice = twice.select(*(F.col(k).alias(f"d_{k}") for k in duplicate_keys))
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"d_{k}") for k in duplicate_keys])
    out = transactions.join(gone, transactions["txn_id"] == gone["u_id"], "left").join(twice, match, "left").join(repeated, F.col("txn_id") == F.col("r_id"), "left")
    return out.withColumns({"is_unmatched": F.col("u_id").isNotNull() | F.coalesce(F.col("amount") >= rules.high_amount, F.lit(False)), "is_incomplete": incomplete, "is_duplicate": F.col(f"d_{duplicate_keys[0]}").isNotNull() | F.col("r_id").isNotNull()}).drop("u_id", "r_id", *(f"d_{k}" for k in duplicate_keys))


def suspicious(transactions: DataFrame, ids: list[DataFrame]) -> DataFrame:
    """Transactions whose id any of the signals names, each id once."""
    named = reduce(DataFrame.unionByName, [d.select("txn_id") for d in ids]).distinct()
    return transactions.join(named, "txn_id", "left_semi").dropDuplicates(["txn_id"])


def resolve_ambiguity(ambiguous: DataFrame, gap: float = AUDIT.gap) -> DataFrame:
    """Rank candidates by score, then id, descending; a gap of at least ``gap`` (or a single candidate) resolves to the top."""
    ranked = F.reverse(F.array_sort(F.zip_with("candidate_scores", "candidate_ids", lambda s, i: F.struct(s.alias("s"), i.alias("i")))))
    out = ambiguous.where("size(candidate_ids) > 0 AND size(candidate_scores) > 0").withColumn("__r", ranked)
    width = F.when(F.size("__r") > 1, F.try_element_at("__r", F.lit(1))["s"] - F.try_element_at("__r", F.lit(2))["s"]).otherwise(F.lit(0.0))
    resolved = (F.size("__r") == 1) | (width >= gap)
    return out.withColumns({"gap": width, "decision": F.when(resolved, F.lit("resolve")).otherwise(F.lit("escalate")), "target_id": F.when(resolved, F.col("__r")[0]["i"])}).drop("__r")


def flag_feedback(flagged: DataFrame, links: DataFrame, at: Column) -> DataFrame:
    """(feedback row): ``flagged`` on the best current link of each flagged transaction; those without a link get none."""
    on = flagged.select("txn_id", "explanation").dropDuplicates(["txn_id"]).join(best_link(links), "txn_id")
    return on.select(*feedback_row(F.col("link_id"), F.lit("flagged"), F.lit("autonomous"), F.col("explanation"), at))


def flags(scored: DataFrame, run_id: str, created_at: Column) -> DataFrame:
    """Flag rows of scored transactions; the id follows from run and transaction."""
    return scored.select(
        T.stable_id(F.lit(run_id), F.col("txn_id")).alias("flag_id"), "txn_id", "vendor", "amount", F.lit(run_id).alias("audit_run_id"), "severity", F.least(F.size("factors") / 3, F.lit(1.0)).alias("confidence"), "explanation",
        F.to_json(F.struct(F.col("factors").alias("contributing_factors"))).alias("evidence"), created_at.alias("created_at"),
    )
