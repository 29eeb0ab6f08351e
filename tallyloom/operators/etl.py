"""Validation and transformation of raw records to silver records, and their upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.schemas import OPTIONAL, RECORDS, REQUIRED


class RejectedRecords(ValueError):
    """Some records lack required fields or break a constraint."""


def missing_fields(df: DataFrame, kind: str) -> Column:
    """Names of all required fields that are absent or null."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) if c in df.columns else F.lit(c) for c in REQUIRED[kind]]))


def present_fields(df: DataFrame, kind: str) -> Column:
    """Names of the optional fields that have a value."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) if c in df.columns else F.lit(None).cast("string") for c in OPTIONAL[kind]]))


def errors(df: DataFrame, kind: str) -> Column:
    """First reason to reject a raw record, or null."""
    checks: list[tuple[Column, Column]] = []
    missing = missing_fields(df, kind)
    checks.append((F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))))
    if kind == "transaction" and "amount" in df.columns:
        checks.append((F.isnan(F.col("amount").cast("double")) | (F.abs(F.col("amount").cast("double")) == float("inf")), F.lit("amount is not finite")))
    if kind == "email":
        if "recipients" in df.columns:
            checks.append((F.size("recipients") < 1, F.lit("no recipients")))
        if "subject" in df.columns:
            checks.append((F.length("subject") > 998, F.lit("subject is too long")))
    if kind == "calendar_event":
        if {"start_time", "end_time"} <= set(df.columns):
            checks.append((F.col("end_time").try_cast("timestamp") < F.col("start_time").try_cast("timestamp"), F.lit("ends before it starts")))
        if "location" in df.columns:
            checks.append((F.length("location") > 500, F.lit("location is too long")))
    out = F.lit(None).cast("string")
    for test, reason in reversed(checks):
        out = F.when(test, reason).otherwise(out)
    return out


def transform(df: DataFrame, kind: str, source: str, ingested_at: Column | None = None, keep_preview: bool = True, keep_attendees: bool = True) -> DataFrame:
    """Silver records of ``kind`` with an ``error`` column, null where the record is fine.

    Strings are stripped; senders are hashed; subjects and previews are masked, previews cut to 255 characters.
    """
    have, schema = set(df.columns), RECORDS[kind]
    columns = []
    for field in schema.fields:
        name, c = field.name, F.col(field.name) if field.name in have else F.lit(None)
        if field.dataType.simpleString() == "string" and name in have:
            c = T.stripped(c.cast("string"))
        if name == "sender":
            c = F.sha2(F.lower(c), 256)
        if name == "subject" or name == "body_preview":
            c = T.masked(c)
        if name == "body_preview":
            c = F.substring(c, 1, 255) if keep_preview else F.lit(None)
        if name == "attendees" and not keep_attendees:
            c = F.lit(None)
        if name == "source":
            c = F.lit(source)
        if name == "ingested_at":
            c = ingested_at if ingested_at is not None else F.current_timestamp()
        if name == "raw_file_ref" and name not in have:
            c = F.lit(None)
        columns.append((c.try_cast(field.dataType) if field.dataType.simpleString() != "array<string>" else c.cast(field.dataType)).alias(name))
    return df.select(*columns, errors(df, kind).alias("error"))


def accepted(silver: DataFrame, strict: bool = True) -> DataFrame:
    """Records without an error; ``strict``: if there are others, raise with their number and the first five reasons."""
    if strict:
        bad = silver.where(F.col("error").isNotNull())
        first = [r["error"] for r in bad.select("error").limit(5).collect()]
        if first:
            raise RejectedRecords(f"{bad.count()} records rejected: " + "; ".join(first))
    return silver.where(F.col("error").isNull()).drop("error")


def newer_than(df: DataFrame, watermark: Column | None, column: str = "ingested_at") -> DataFrame:
    """Strictly newer than the watermark; none (or null) keeps all."""
    return df if watermark is None else df.where(watermark.isNull() | (F.col(column) > watermark))


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str = "ingested_at") -> DataFrame:
    """One row a key: of the latest ``order``; of equals, the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def first_by(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row a key: the one of least position."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(position))).where("__n = 1").drop("__n")
