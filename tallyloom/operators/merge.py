"""Merges as plans from tables to tables; writing them is the store's business."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A link is the same if all of these are.
IDENTITY = ("source_id", "target_id", "match_tier", "confidence", "linkage_key", "rule_version")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], preserve: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones with equal keys (nulls are equal); ``preserve``: columns that keep the old value."""
    kept = old.join(new, null_safe(old, new, keys), "left_anti")
    if preserve:
        before = old.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"__old_{c}") for c in preserve))
        match = reduce(lambda a, b: a & b, [new[k].eqNullSafe(before[f"__{k}"]) for k in keys])
        new = new.join(before, match, "left").select(*(F.coalesce(F.col(f"__old_{c}"), new[c]).alias(c) if c in preserve else new[c] for c in new.columns))
    return kept.unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The first write wins: of ``new`` one row for each key that ``old`` lacks, nulls equal."""
    return old.unionByName(new.dropDuplicates(keys).join(old, null_safe(new, old, keys), "left_anti"), allowMissingColumns=True)


def scd2(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """All link versions after the merge, with ``action``: kept, closed or inserted.

    An absent link is inserted, an identical one is left alone, a changed one is closed at the proposal's start and
    inserted anew; the closed version names its successor.
    """
    live = current.where("is_current")
    p = proposed.select(F.col("source_id").alias("p_s"), F.col("target_id").alias("p_t"), F.struct(*proposed.columns).alias("p"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"p.{c}")) for c in IDENTITY])
    judged = live.join(p, (F.col("source_id") == F.col("p_s")) & (F.col("target_id") == F.col("p_t")), "left")
    closes = F.col("p").isNotNull() & ~same
    after = judged.withColumns(
        {"effective_to": F.when(closes, F.col("p.effective_from")).otherwise(F.col("effective_to")), "is_current": ~closes, "superseded_by": F.when(closes, F.col("p.link_id")).otherwise(F.col("superseded_by")), "action": F.when(closes, F.lit("closed")).otherwise(F.lit("kept"))}
    ).select(*current.columns, "action")
    known = live.select(*(F.col(c).alias(f"k_{c}") for c in IDENTITY))
    unchanged = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in IDENTITY])
    fresh = proposed.join(known, unchanged & (F.col("source_id") == F.col("k_source_id")), "left_anti").withColumns({"is_current": F.lit(True), "action": F.lit("inserted")})
    history = current.where("NOT is_current").withColumn("action", F.lit("kept"))
    return history.unionByName(after).unionByName(fresh, allowMissingColumns=True)


def soft_delete(links: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Close current links whose id is in ``gone`` (link_id, optional superseded_by)."""
    marks = gone.select(F.col("link_id").alias("g_id"), (F.col("superseded_by") if "superseded_by" in gone.columns else F.lit(None).cast("string")).alias("g_by"))
    hit = F.col("g_id").isNotNull() & F.col("is_current")
    return links.join(marks, links["link_id"] == marks["g_id"], "left").withColumns({"effective_to": F.when(hit, at).otherwise(F.col("effective_to")), "superseded_by": F.when(hit, F.col("g_by")).otherwise(F.col("superseded_by")), "is_current": F.col("is_current") & ~hit}).select(*links.columns)


def purge(df: DataFrame, column: str, before: Column) -> DataFrame:
    """Rows whose time is not before the cut-off; rows without a time stay."""
    return df.where(F.col(column).isNull() | (F.col(column) >= before))


def erase(tables: dict[str, DataFrame], entity_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove everything about an entity; (tables after, counts by table).

    Feedback is found through the links before these go, and ambiguous matches also by their candidates.
    """
    e = F.lit(entity_id)
    rules = {
        "entity_links": lambda d: (d["source_id"] == e) | (d["target_id"] == e),
        "unmatched_entities": lambda d: d["entity_id"] == e,
        "ambiguous_matches": lambda d: (d["source_entity_id"] == e) | F.array_contains(d["candidate_ids"], e),
    }
    after, counts = dict(tables), []
    if {"entity_links", "link_feedback"} <= set(tables):
        own = tables["entity_links"].where(rules["entity_links"](tables["entity_links"])).select("link_id").distinct()
        after["link_feedback"] = tables["link_feedback"].join(own, "link_id", "left_anti").select(*tables["link_feedback"].columns)
        counts.append(tables["link_feedback"].join(own, "link_id", "left_semi").agg(F.lit("link_feedback").alias("table"), F.count("*").alias("rows_deleted")))
    for name, test in rules.items():
        if name in tables:
            hit = F.coalesce(test(tables[name]), F.lit(False))
            after[name] = tables[name].where(~hit)
            counts.append(tables[name].where(hit).agg(F.lit(name).alias("table"), F.count("*").alias("rows_deleted")))
    return after, reduce(DataFrame.unionByName, counts)
