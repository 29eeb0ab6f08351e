"""Escalation as the contract's documents specify it, beyond what its code does: severity from all agents' findings,
recurring vendors, uncertain rows in batches, and receipts that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import AUDIT, AuditRules
from tallyloom.operators import reconcile
from tallyloom.operators.severity import whitelisted
from tallyloom.sources.files import numbered


def contextual_severity(df: DataFrame, rules: AuditRules = AUDIT, anomalous: float = 70) -> DataFrame:
    """Add score (0 to 100), severity, factors and explanation from is_unmatched, anomaly_score, email_approval and receipt_found.

    A null is no missing match and no anomaly, but neither an approval nor a receipt. The explanation numbers its reasons;
    a row without a factor has none.
    """
    unmatched, odd = F.coalesce(F.col("is_unmatched"), F.lit(False)), F.coalesce(F.col("anomaly_score") > anomalous, F.lit(False))
    absent = {c: ~F.coalesce(F.col(c), F.lit(False)) for c in ("email_approval", "receipt_found")}
    # Weight, factor, reason.
    tests = [
        (unmatched, 40, "no_reconciliation_match", F.lit("No matching bank transaction found")),
        (odd, 30, "anomaly", F.concat(F.lit("Anomaly score "), F.col("anomaly_score").cast("string"))),
        (absent["email_approval"], 20, "no_email_approval", F.lit("No email approval located")),
        (absent["receipt_found"], 10, "no_receipt", F.lit("Receipt not found")),
    ]
    score = sum((F.when(t, w).otherwise(0) for t, w, _, _ in tests), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(t, x) for t, _, _, x in tests]))
    listed = F.array_join(F.transform(reasons, lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), x)), ", ")
    out = df.withColumns({"score": score, "factors": F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, _, n, _ in tests]))})
    level = F.when(F.col("score") >= rules.critical, F.lit("CRITICAL")).when(F.col("score") >= rules.warning, F.lit("WARNING")).otherwise(F.lit("INFO"))
    return out.withColumns({"severity": level, "explanation": F.when(F.size("factors") > 0, F.concat(F.lit("Flagged because: "), listed, F.lit(".")))})


def recurring(history: DataFrame, months: int = 3) -> DataFrame:
    """(vendor, usual): mean amount of vendors with transactions in at least ``months`` months.

    Sums by month come first, so a vendor that holds a third of all rows is few rows when its months meet.
    """
    known = history.where("vendor IS NOT NULL AND amount IS NOT NULL AND date IS NOT NULL")
    monthly = known.groupBy("vendor", F.date_trunc("month", "date").alias("__month")).agg(F.sum("amount").alias("__sum"), F.count("*").alias("__n"))
    return monthly.groupBy("vendor").agg(F.try_divide(F.sum("__sum"), F.sum("__n")).alias("usual"), F.count("*").alias("__months")).where(F.col("__months") >= months).select("vendor", "usual")


def settled(df: DataFrame, history: DataFrame, percent: float = 5.0, months: int = 3) -> DataFrame:
    """``df`` with severity one level lower where a recurring vendor's amount differs by less than ``percent`` from its mean."""
    usual = recurring(history, months).withColumnRenamed("vendor", "__vendor")
    near = F.coalesce(F.try_divide(F.abs(F.col("amount") - F.col("usual")), F.abs("usual")) * 100 < percent, F.lit(False))
    lower = F.when(F.col("severity") == "CRITICAL", F.lit("WARNING")).when(F.col("severity") == "WARNING", F.lit("INFO")).otherwise(F.col("severity"))
    joined = df.join(usual, F.col("vendor") == F.col("__vendor"), "left")
    return joined.withColumns({"is_settled": near, "severity": F.when(near, lower).otherwise(F.col("severity"))}).drop("__vendor", "usual")


def uncertain(scored: DataFrame, order: list[str], low: int = 40, high: int = 60, size: int = 100) -> DataFrame:
    """(batch, rows): rows with a score of ``low`` to ``high`` in batches of ``size``, in ``order``, which is total.

    Rows are numbered by ranges; a batch holds ``size`` rows at most, whatever there is of them.
    """
    placed = numbered(scored.where(F.col("score").between(low, high)), order, "__n", "%d").withColumn("__n", F.col("__n").cast("bigint"))
    row = F.struct("__n", *(c for c in placed.columns if c != "__n"))
    batch = F.floor((F.col("__n") - 1) / size).cast("bigint")
    rows = F.transform(F.array_sort(F.collect_list("__row")), lambda r: r.dropFields("__n"))
    return placed.select(batch.alias("batch"), row.alias("__row")).groupBy("batch").agg(rows.alias("rows"))


def missing_receipts(transactions: DataFrame, found: DataFrame, now: Column, exempt: DataFrame | None = None, grace: int = 7) -> DataFrame:
    """Transactions older than ``grace`` days that no receipt fits, without those of ``exempt`` vendors (vendor).

    A row without a date or an amount is no missing receipt: there is nothing that a receipt could be held against.
    """
    due = transactions.where(F.col("amount").isNotNull() & (F.to_date("date") < F.date_sub(F.to_date(now), grace)))
    if exempt is not None:
        due = whitelisted(due, exempt).where("NOT is_whitelisted").drop("is_whitelisted")
    return reconcile.with_receipt(due, found).where("NOT receipt_found").drop("receipt_found")
