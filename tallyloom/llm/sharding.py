"""Sharding by sampled splitters: range partition on a content key with near-equal bytes in every shard.

1. Every record gets a size and a key: 32 bits of its text's hash, then 32 bits of its id's, so equal texts are
   neighbours and yet even a group with a third of all rows can be divided.
2. A size-weighted key sample (its expected number is a parameter) gives quantile boundaries of many small ranges.
3. The real sizes of the ranges are measured over all records; overfull ranges are sampled again and subdivided.
4. Within its range a record's exact position in bytes follows from a running sum, so a shard's border falls between
   two records. So as not to cut a group of equal texts, a border may move by ``TOLERANCE`` of a shard: a group of at most
that size, at every size of the table, goes whole to the shard of its middle, and a larger one is divided.

Law: ``bytes``. Only range statistics (a bounded number of rows) reach the driver. Defined results: null text counts as
none (size 1); repeated rows each get a slot; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.llm.common import save

#: Ranges in a shard, and sampled keys in a range.
RANGES, SAMPLES = 128, 16
#: By what part of its size a shard may differ from the others for the sake of whole groups of equal texts.
TOLERANCE = 0.01


def records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, at): at is the range key."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    high = F.shiftright(F.xxhash64(body), 32) * F.lit(1 << 32)
    low = F.shiftrightunsigned(F.xxhash64(F.col(key)), 32)
    return docs.select(F.col(key), (F.length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), (high + low).alias("at"))


def weighted_sample(rows: DataFrame, expected: int, total: int, salt: int) -> list[tuple[int, float]]:
    """(at, weight) of about ``expected`` rows, drawn in proportion to size by a fixed hash."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(expected / max(total, 1)))
    draw = F.shiftrightunsigned(F.xxhash64("at", "size", F.lit(salt)), 11) / F.lit(float(1 << 53))
    return [(r["at"], r["weight"]) for r in rows.where(draw < chance).select("at", (F.col("size") / chance).alias("weight")).collect()]


def quantiles(sample: list[tuple[int, float]], ranges: int, whole: float) -> list[int]:
    """Weighted quantiles; a border inside a group of equal texts moves to its start, unless the group is over ``whole``."""
    if not sample:
        return []
    at, weight = (np.array(x) for x in zip(*sorted(sample), strict=True))
    upto = np.cumsum(weight)
    cuts = at[np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges).clip(0, len(at) - 1)]
    _, member = np.unique(at >> 32, return_inverse=True)
    large = np.unique((at >> 32)[np.bincount(member, weights=weight)[member] > whole])
    return sorted({int(x) for x in np.where(np.isin(cuts >> 32, large), cuts, (cuts >> 32) << 32)})


def in_ranges(rows: DataFrame, splits: list[int]) -> DataFrame:
    """Add ``range``: the number of splitters at or below the key."""
    borders = np.array(splits, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.schema.get_field_index("at")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.searchsorted(borders, at, side="right").astype(np.int64))], names=[*b.schema.names, "range"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("range", LongType())]))


def splitters(rows: DataFrame, ranges: int, total: int, whole: float) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Boundaries, and (bytes, rows) of every range, after overfull ranges were sampled again and subdivided.

    It ends when no range is overfull or nothing can be divided any further: what is left then are rows of one key.
    """
    splits, sizes = quantiles(weighted_sample(rows, ranges * SAMPLES, total, 0), ranges, whole), {}
    for salt in count(1):
        ranged = in_ranges(rows, splits)
        sizes = {r["range"]: (r["b"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        over = [k for k, (b, n) in sizes.items() if b > 3 * total / ranges and n > 1]
        if not over:
            break
        finer = set(splits)
        heavy = ranged.where(F.col("range").isin(over))
        bytes_over = sum(sizes[k][0] for k in over)
        wanted = int(-(-2 * bytes_over * ranges // total))
        sample = weighted_sample(heavy, wanted * SAMPLES, bytes_over, salt)
        if sample:
            finer |= set(quantiles(sample, wanted, whole))
        if finer == set(splits):
            break
        splits = sorted(finer)
    return splits, sizes


def shard_by_bytes(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    rows = save(records(docs, key, text), "records")
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = TOLERANCE * total / shards
    splits, sizes = splitters(rows, shards * RANGES, total, limit)
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets.append((k, before))
        before += sizes[k][0]
    spark = docs.sparkSession
    place = F.broadcast(spark.createDataFrame(offsets, "range long, before long"))  # at most a few thousand rows
    order = [F.col("at"), F.col(key), F.col("size"), F.col("text_crc32")]
    ahead = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", F.shiftright("at", 32))
    start = F.col("before") + F.coalesce(F.sum("size").over(ahead), F.lit(0))
    ranged = in_ranges(rows, splits).join(place, "range").withColumn("start", start).withColumn("g_size", F.sum("size").over(group)).withColumn("g_start", F.min("start").over(group))
    whole = F.col("g_size") <= limit
    middle = F.when(whole, F.col("g_start") * 2 + F.col("g_size")).otherwise(F.col("start") * 2 + F.col("size"))
    placed = save(ranged.withColumn("shard", F.least(F.floor(middle * shards / (2 * max(total, 1))), F.lit(shards - 1)).cast("int")).select(key, "size", "text_crc32", "at", "range", "shard"), "placed")
    counts = sorted((r["shard"], r["range"], r["n"]) for r in placed.groupBy("shard", "range").agg(F.count("*").alias("n")).collect())
    first, last, filled = [], None, 0
    for s, k, n in counts:
        filled = 0 if s != last else filled
        first.append((s, k, filled))
        last, filled = s, filled + n
    base = F.broadcast(spark.createDataFrame(first, "shard int, range long, filled long"))
    rank = F.row_number().over(Window.partitionBy("range", "shard").orderBy(*order))
    return placed.join(base, ["shard", "range"]).select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("filled") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
