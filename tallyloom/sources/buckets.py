"""Merges that rewrite only what they touch: a Parquet table in buckets of its key, replaced bucket by bucket.

The table is partitioned by ``bucket``, a hash of the key. A merge reads the buckets that the new rows fall into, works
out their rows by any of ``operators.merge``, and writes them with Spark's dynamic partition overwrite: all other
buckets keep their files. Writers must not overlap (one run at a time, as the contract has it).

Defined results: null keys are equal and share a bucket; a merge of nothing writes nothing; a bucket that a merge empties
loses its files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import cut, delete


class Bucketed:
    """A table at ``path`` in ``buckets`` buckets of ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def create(self, df: DataFrame) -> None:
        self._placed(df).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def merge(self, new: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets that ``new`` touches by ``work(old, new)`` of them; returns their numbers."""
        placed = cut(self._placed(new))
        touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched)).drop("bucket")
        after = cut(self._placed(work(old, placed.drop("bucket"))))
        left = {r["bucket"] for r in after.select("bucket").distinct().collect()}
        if not left <= set(touched):
            raise ValueError("a merge may not move rows to buckets that it doesn't touch")
        after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for bucket in set(touched) - left:
            delete(self.spark, f"{self.path}/bucket={bucket}")
        return touched
