"""Evaluation against ground truth, histograms and source summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import CONFIDENCE_BANDS


def confusion(found: DataFrame, truth: DataFrame, total: int | None = None, ident: str = "txn_id", everything: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of one id set against another; undefined ratios are null."""
    f, c = (d.select(F.col(ident).alias("i")).distinct() for d in (found, truth))
    both = f.withColumn("f", F.lit(1)).join(c.withColumn("c", F.lit(1)), "i", "full_outer")
    counts = both.agg(F.count_if(F.col("f").isNotNull() & F.col("c").isNotNull()).alias("tp"), F.count_if(F.col("c").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    if everything is not None:
        counts = counts.crossJoin(everything.agg(F.count("*").alias("__all")))
    else:
        counts = counts.withColumn("__all", F.lit(total).cast("long"))
    counts = counts.withColumn("tn", F.col("__all") - F.col("tp") - F.col("fp") - F.col("fn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": precision, "recall": recall, "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("__all"))})
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("__all")


def confusion_by(found: DataFrame, truth: DataFrame, everything: DataFrame, by: str, ident: str = "txn_id") -> DataFrame:
    """``confusion`` of every data set in one grouped aggregate; the data sets are the values of ``by`` in ``everything``."""
    sides = [d.select(by, F.col(ident).alias("i"), *(F.lit(int(k == s)).alias(k) for k in "fca")) for s, d in zip("fca", (found, truth, everything), strict=True)]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy(by, "i").agg(*(F.max(k).alias(k) for k in "fca"))
    counts = rows.groupBy(by).agg(F.sum(F.col("f") * F.col("c")).alias("tp"), F.sum(F.col("f") * (1 - F.col("c"))).alias("fp"), F.sum((1 - F.col("f")) * F.col("c")).alias("fn"), F.sum("a").alias("__all")).where("__all > 0")
    counts = counts.withColumn("tn", F.col("__all") - F.col("tp") - F.col("fp") - F.col("fn"))
    out = counts.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("__all"))})
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("__all")


def confidence_band(confidence: Column) -> Column:
    """high, medium or ambiguous by the least confidence of each band; below them, or without one: none."""
    bands = sorted(CONFIDENCE_BANDS.items(), key=lambda kv: -kv[1])
    return F.coalesce(*(F.when(confidence >= least, F.lit(name)) for name, least in bands), F.lit("none"))


def macro_average(scores: DataFrame, pass_mark: float = 0.80) -> DataFrame:
    return scores.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.count_if(F.col("f1") >= pass_mark).alias("passed"), F.count("*").alias("datasets"))


def links_per_tier(links: DataFrame) -> DataFrame:
    return links.where("is_current").groupBy("match_tier").agg(F.count("*").alias("n"))


def severity_histogram(flags: DataFrame) -> DataFrame:
    return flags.groupBy("severity").agg(F.count("*").alias("n"))


def source_summary(df: DataFrame, source: str = "source", date: str = "date") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"), F.min(date).alias("first"), F.max(date).alias("last"))


def coverage(receipts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Receipts per transaction."""
    return receipts.agg(F.count("*").alias("receipts")).crossJoin(transactions.agg(F.count("*").alias("transactions"))).withColumn("coverage", F.coalesce(F.try_divide("receipts", "transactions"), F.lit(0.0)))


def unmatched_rate(unmatched: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_type, target_type, n, rate): unmatched by pair over all entities of the source type (entity_type, total)."""
    n = unmatched.groupBy(F.col("entity_type").alias("source_type"), F.coalesce("target_type", F.lit("unknown")).alias("target_type")).agg(F.count("*").alias("n"))
    return n.join(entities.withColumnRenamed("entity_type", "source_type"), "source_type", "left").select("source_type", "target_type", "n", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("rate"))
