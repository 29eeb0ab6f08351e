"""Data-quality profiles over transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import AUDIT
from tallyloom.schemas import ACCEPTED

#: The fields that completeness is measured on.
FIELDS = ("vendor", "amount", "date", "source")


def completeness(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row: total, missing_<field> (an absent column lacks everywhere) and completeness_score, three decimals."""
    missing = {f: F.count("*") - F.count(f) if f in df.columns else F.count("*") for f in fields}
    total = sum(missing.values(), F.lit(0))
    score = F.coalesce(F.round(1 - F.try_divide(total, F.count("*") * len(fields)), 3), F.lit(0.0))
    return df.agg(F.count("*").alias("total_records"), *(c.cast("long").alias(f"missing_{f}") for f, c in missing.items()), score.alias("completeness_score"))


def passes_gate(df: DataFrame, threshold: float = AUDIT.completeness) -> DataFrame:
    return completeness(df).select("completeness_score", (F.col("completeness_score") >= threshold).alias("passed"))


def duplicate_groups(df: DataFrame, keys: list[str], ident: str, most_ids: int = 5) -> DataFrame:
    """Groups of rows with equal, non-null keys: their number and first ids."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(ident)))  # ids beyond the first few are never gathered
    ids = F.sort_array(F.collect_list(F.when(F.col("__n") <= most_ids, F.col(ident))))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), ids.alias("ids")).where("n > 1")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once; null keys are equal here."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n > 1").drop("__n")


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """(duplicate_count in rows, null keys included; duplicate_groups without those that hold a null)."""
    if any(k not in df.columns for k in keys):
        return df.sparkSession.createDataFrame([(0, 0)], "duplicate_count long, duplicate_groups long")
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_count"), F.count_if(whole).alias("duplicate_groups"))


def conformity(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(field, problem): missing fields and types that are not accepted; unknown expectations are passed over."""
    types, rows = dict(df.dtypes), []
    for name, wanted in expected.items():
        if name not in types:
            rows.append((name, "Missing field"))
        elif wanted in ACCEPTED and types[name] not in ACCEPTED[wanted]:
            rows.append((name, f"Type mismatch: expected {wanted}, got {types[name]}"))
    return df.sparkSession.createDataFrame(rows, "field string, problem string")


def domain_freshness(df: DataFrame, domain: str, domains: dict[str, tuple[int, float]] = AUDIT.domains) -> DataFrame:
    """Add max_age_hours and domain_confidence: named domains, else the default entry, 1.0; without either 48 h, 0.5."""
    known = {k: v[0] for k, v in domains.items()}
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    named = F.element_at(F.create_map(*pairs), F.col(domain)) if pairs else F.lit(None).cast("int")
    default = F.lit(known.get("default")).cast("int")
    age = F.coalesce(named, default)
    return df.withColumns({"max_age_hours": F.coalesce(age, F.lit(48)), "domain_confidence": F.when(age.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.5))})
