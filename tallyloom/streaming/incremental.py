"""Incremental runs: files are taken once each, in micro-batches, with the checkpoint as the cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def take_new(spark: SparkSession, path: str, schema: StructType, handle: Callable[[DataFrame, int], None], checkpoint: str, file_format: str = "parquet", max_files: int = 1000, glob: str | None = None) -> StreamingQuery:
    """Hand all files of a folder (that ``glob`` fits) which no earlier run has taken to ``handle(batch, batch_id)``, then stop."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(file_format)
    stream = (reader if glob is None else reader.option("pathGlobFilter", glob)).load(path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, window: str, late: str, keys: list[str], value: str | None = None) -> DataFrame:
    """Counts (and sums) by event-time window with a watermark: late rows within ``late`` are still counted."""
    out = stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *keys)
    return out.agg(F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])).select(F.col("w.start").alias("window_start"), *keys, "n", *(["total"] if value else []))


def sessions(stream: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of a key: events no more than ``gap`` apart."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_seen(stream: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def advanced(watermarks: DataFrame, kinds: list[str], run_id: str, at: Column) -> DataFrame:
    """Watermarks of these entity types moved to ``at``."""
    spark = watermarks.sparkSession
    new = spark.createDataFrame([(k, run_id) for k in kinds], "entity_type string, last_run_id string").withColumn("last_ingested_at", at)
    return watermarks.join(new.select("entity_type"), "entity_type", "left_anti").unionByName(new, allowMissingColumns=True).select("entity_type", "last_ingested_at", "last_run_id")


def start_date(watermarks: DataFrame, at: Column, lookback: int = 90) -> DataFrame:
    """One row: the day from which transactions are fetched; the watermark's day, else ``lookback`` days ago."""
    return watermarks.where("entity_type = 'transaction'").agg(F.coalesce(F.to_date(F.max("last_ingested_at")), F.date_sub(F.to_date(at), lookback)).alias("start_date"))
