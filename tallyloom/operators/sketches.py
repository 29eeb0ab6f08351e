"""Summaries by day that can be merged: latencies as quantile sketches, coverage as distinct sketches.

A day is summarised once; any span of days is the merge of its days' sketches and never reads the rows again. Errors:
quantile ranks within about 1.33 % for k = 200, distinct counts within about 3.2 % for 12 bits (two standard errors).

Defined results: null values are not counted; a day without values has no row; merging nothing gives nulls and zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.5, 0.9, 0.99)


def daily_latency(df: DataFrame, day: Column, seconds: Column, k: int = 200) -> DataFrame:
    """(day, n, sketch) of the latencies of each day."""
    rows = df.select(day.alias("day"), seconds.cast("double").alias("s")).where("day IS NOT NULL AND s IS NOT NULL")
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("s", k).alias("sketch"))


def merged_latency(daily: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(n, p50, p90, p99) of all days given, from their sketches."""
    whole = daily.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.kll_merge_agg_double("sketch").alias("__s"))
    return whole.select("n", *(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("__s", F.lit(float(q)))).alias(f"p{round(100 * q)}") for q in quantiles))


def daily_coverage(df: DataFrame, day: Column, entity: Column, covered: Column, bits: int = 12) -> DataFrame:
    """(day, entities, covered): distinct sketches of all entities of a day, and of those that are covered."""
    rows = df.select(day.alias("day"), entity.cast("string").alias("e"), F.when(covered, entity.cast("string")).alias("c")).where("day IS NOT NULL")
    return rows.groupBy("day").agg(F.hll_sketch_agg("e", bits).alias("entities"), F.hll_sketch_agg("c", bits).alias("covered"))


def merged_coverage(daily: DataFrame) -> DataFrame:
    """(entities, covered, coverage) of all days given, from their sketches."""
    count = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("long").alias(c)
    return daily.agg(count("entities"), count("covered")).withColumn("coverage", F.coalesce(F.try_divide("covered", "entities"), F.lit(0.0)))
