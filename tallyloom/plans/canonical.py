"""Shapes of the driver's tables as the record types of this library; nulls are put in by key arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions with missing vendors, amounts and dates."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('T', o_orderkey) AS txn_id", "o_orderkey AS pos", "CASE WHEN o_orderkey % 7 <> 0 THEN concat('Vendor ', o_custkey % 50) END AS vendor", "CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS amount",
        "CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS date) END AS date", "CASE WHEN o_orderkey % 3 = 0 THEN 'bank' ELSE 'credit_card' END AS source",
    )


GOLD = """gold AS (SELECT 'T' || o_orderkey AS txn_id, o_orderkey AS pos, CASE WHEN o_orderkey % 7 <> 0 THEN 'Vendor ' || (o_custkey % 50) END AS vendor,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS date) END AS date,
    CASE WHEN o_orderkey % 3 = 0 THEN 'bank' ELSE 'credit_card' END AS source FROM orders)"""


def part_entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even parts as sources and odd parts as targets: names repeat, days are near each other."""
    parts = table(spark, sf_dir, "part")

    def side(odd: int, every: int) -> DataFrame:
        return parts.where(f"p_partkey % 2 = {odd}").selectExpr(
            "concat('P', p_partkey) AS entity_id", "p_partkey AS pos", f"date_add(DATE'2024-01-01', CAST(floor(p_partkey / {every}) % 30 AS int)) AS day", f"CASE WHEN p_partkey % 10 < 2 THEN CAST(floor(p_partkey / 10) AS string) END AS exact",
            "lower(p_name) AS composite", "lower(p_name) AS fuzzy", "'subject' AS fuzzy_field",
        )

    return side(0, 2), side(1, 3)


PARTS = """s AS (SELECT 'P' || p_partkey AS source_id, p_partkey AS pos, DATE '2024-01-01' + CAST((p_partkey // 2) % 30 AS int) AS day, CASE WHEN p_partkey % 10 < 2 THEN CAST(p_partkey // 10 AS varchar) END AS exact, lower(p_name) AS name FROM part WHERE p_partkey % 2 = 0),
    t AS (SELECT 'P' || p_partkey AS target_id, p_partkey AS pos, DATE '2024-01-01' + CAST((p_partkey // 3) % 30 AS int) AS day, CASE WHEN p_partkey % 10 < 2 THEN CAST(p_partkey // 10 AS varchar) END AS exact, lower(p_name) AS name FROM part WHERE p_partkey % 2 = 1)"""


def event_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases and clicks as two sources, the user as vendor."""
    events = table(spark, sf_dir, "events").selectExpr("concat('E', event_id) AS txn_id", "event_id AS pos", "concat('U', user_id) AS vendor", "value AS amount", "ts AS date", "event_type AS source")
    return events.where("source = 'purchase'"), events.where("source = 'click'")


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a link history and as proposals, some the same, some changed, some new."""
    orders = table(spark, sf_dir, "orders")
    base = ["concat('S', o_orderkey) AS source_id", "concat('C', o_custkey) AS target_id", "'transaction' AS source_type", "'email' AS target_type", "'deterministic' AS match_type"]
    current = orders.where("o_orderkey % 3 <> 0").selectExpr("concat('L', o_orderkey) AS link_id", *base, "'tier2_composite' AS match_tier", "0.9D AS confidence", "'k' AS linkage_key", "'1.0' AS rule_version", "TIMESTAMP'2024-01-01 00:00:00' AS created_at", "TIMESTAMP'2024-01-01 00:00:00' AS effective_from", "CAST(NULL AS timestamp) AS effective_to", "o_orderkey % 10 <> 1 AS is_current", "CAST(NULL AS string) AS superseded_by")
    proposed = orders.where("o_orderkey % 2 = 0").selectExpr("concat('N', o_orderkey) AS link_id", *base, "CASE WHEN o_orderkey % 5 = 0 THEN 'tier3_fuzzy' ELSE 'tier2_composite' END AS match_tier", "0.9D AS confidence", "'k' AS linkage_key", "'1.0' AS rule_version", "TIMESTAMP'2024-02-01 00:00:00' AS created_at", "TIMESTAMP'2024-02-01 00:00:00' AS effective_from", "CAST(NULL AS timestamp) AS effective_to", "true AS is_current", "CAST(NULL AS string) AS superseded_by")
    return current, proposed


LINKS = """cur AS (SELECT 'L' || o_orderkey AS link_id, 'S' || o_orderkey AS source_id, 'C' || o_custkey AS target_id, 'tier2_composite' AS match_tier, o_orderkey % 10 <> 1 AS is_current, o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0),
    pro AS (SELECT 'N' || o_orderkey AS link_id, 'S' || o_orderkey AS source_id, 'C' || o_custkey AS target_id, CASE WHEN o_orderkey % 5 = 0 THEN 'tier3_fuzzy' ELSE 'tier2_composite' END AS match_tier, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0)"""
