"""Runs that go on where they failed: a stage is skipped if its input, and what it does, are what they were.

Specified by the contract's documents; its code imports the restoring of a state and never calls it: see README.

An input is known by an order-free fingerprint, the number of its rows and sums of their hashes, which is one aggregate
without a shuffle of rows. Every stage's rows are written below the folder together with the fingerprint of what they
were made of, data first, so a run that fails leaves no stage that looks finished.

Defined results: rows that repeat count each; the order of rows and files doesn't matter, columns and their order do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def fingerprint(df: DataFrame) -> str:
    """Rows, and two sums of their 64-bit hashes with different seeds: equal for the same rows in any order."""
    row = F.struct(*df.columns) if df.columns else F.lit(0)
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38, 0)"))
    out = df.agg(F.count("*").alias("n"), total(row).alias("a"), total(F.lit(1), row).alias("b")).first()
    return f"{df.schema.simpleString()}|{out['n']}|{out['a']}|{out['b']}"


class Resumable:
    """Stages (name, version, function) run one after the other, each one's rows kept below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _known(self, name: str) -> str | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/made_of")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(at.toString()).first()["made_of"]

    def run(self, start: DataFrame, stages: list[tuple[str, str, Stage]]) -> tuple[DataFrame, list[str]]:
        """(rows of the last stage, names of the stages that had to run)."""
        df, ran = start, []
        for name, version, stage in stages:
            made_of = f"{version}|{fingerprint(df)}"
            rows, mark = f"{self.folder}/{name}/rows", f"{self.folder}/{name}/made_of"
            if self._known(name) != made_of:
                self.spark.createDataFrame([("unfinished",)], "made_of string").write.mode("overwrite").parquet(mark)
                stage(df).write.mode("overwrite").parquet(rows)
                self.spark.createDataFrame([(made_of,)], "made_of string").coalesce(1).write.mode("overwrite").parquet(mark)
                ran.append(name)
            df = self.spark.read.parquet(rows)
        return df, ran
