"""Reads over stored tables: gold transactions, linked and unmatched ids, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gold_transactions(transactions: DataFrame, since: Column | None = None) -> DataFrame:
    """Eight columns, the vendor from merchant or raw name; optionally only what was ingested later."""
    rows = transactions if since is None else transactions.where(F.col("ingested_at") > since)
    return rows.select(F.col("transaction_id").alias("txn_id"), F.coalesce("merchant_name", "name", F.lit("Unknown")).alias("vendor"), "amount", "date", "category", "source", "account_id", "ingested_at")


def linked_ids(links: DataFrame) -> DataFrame:
    return links.where("source_type = 'transaction' AND is_current").select(F.col("source_id").alias("txn_id")).distinct()


def unmatched_ids(unmatched: DataFrame) -> DataFrame:
    return unmatched.where("entity_type = 'transaction'").select(F.col("entity_id").alias("txn_id")).distinct()


def last_run(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin("success", "partial")).agg(F.max("start_time").alias("last_run"))


def last_audit(states: DataFrame, default: str = "2025-01-01") -> DataFrame:
    return states.where("workflow_status = 'completed'").agg(F.coalesce(F.max("created_at"), F.lit(default).cast("timestamp")).alias("last_audit"))


def is_fresh(runs: DataFrame, at: Column, hours: int = 24) -> DataFrame:
    """One row: whether the last good run started no more than ``hours`` ago; without a run it isn't."""
    age = F.try_subtract(at.cast("timestamp").cast("double"), F.col("last_run").cast("timestamp").cast("double"))
    return last_run(runs).select("last_run", F.coalesce(age <= hours * 3600, F.lit(False)).alias("is_fresh"))


def match_status(transactions: DataFrame, linked: DataFrame) -> DataFrame:
    """Add reconciliation_matched: whether the transaction is linked."""
    mark = linked.select(F.col("txn_id").alias("__l")).distinct()
    return transactions.join(mark, transactions["txn_id"] == mark["__l"], "left").withColumn("reconciliation_matched", F.col("__l").isNotNull()).drop("__l")


def point(df: DataFrame, **keys: object) -> DataFrame:
    """The row with these key values."""
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v))
    return df.limit(1)


def exists(df: DataFrame, **keys: object) -> bool:
    return not point(df, **keys).isEmpty()


def known(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``exists`` in bulk: the keys of ``wanted`` with ``known``, whether ``df`` has them; null keys are never known."""
    have = df.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    met = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__{k}") for k in keys))
    return wanted.select(*keys).join(have, met, "left").select(*keys, F.col(f"__{keys[0]}").isNotNull().alias("known"))
