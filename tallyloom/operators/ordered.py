"""Operators over one order of all rows, without a window that gathers all rows in one task.

Rows are dealt into ranges of the order, written once, and every range is worked on for itself; what a range needs from
those before it, the last rows (a halo) or the last values of a key, is at most a few rows for each range or for each key
and range, and is joined to it.

Defined results: nulls in the order come first; rows that are equal in the order follow each other in an unspecified
order, so give a unique last column; null keys are a key of their own; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import AUDIT
from tallyloom.operators.anomaly import deviating
from tallyloom.session import cut


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in ranges of ``order``, ascending, nulls first: ``__part`` numbers the ranges."""
    return cut(df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).withColumn("__part", F.spark_partition_id()))


def with_halo(parts: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Rows of ranges and, with ``__halo`` true, before each range the last ``rows`` rows of the order before it.

    The ends of the ranges, ``rows`` rows each, are one row for each range; each looks at the ``rows`` ranges before it
    that are not empty, which hold enough.
    """
    back = Window.partitionBy("__part").orderBy(*(F.col(c).desc_nulls_last() for c in order))
    ends = parts.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= rows)
    row = F.struct(*(c for c in parts.columns if c != "__part"))
    tails = ends.groupBy("__part").agg(F.collect_list(F.struct(F.col("__part").alias("p"), F.col("__back").alias("back"), row.alias("row"))).alias("__tail"))
    earlier = Window.orderBy("__part").rowsBetween(-rows, -1)  # one row a range, whatever the data's size
    halo = tails.select("__part", F.flatten(F.collect_list("__tail").over(earlier)).alias("__before")).select("__part", F.explode("__before").alias("__one"))
    nearest = Window.partitionBy("__part").orderBy(F.desc("__one.p"), "__one.back")
    halo = halo.withColumn("__n", F.row_number().over(nearest)).where(F.col("__n") <= rows).select("__one.row.*", "__part", F.lit(True).alias("__halo"))
    return parts.withColumn("__halo", F.lit(False)).unionByName(halo)


def rolling_deviation(df: DataFrame, order: list[str], value: str, percent: float = AUDIT.rolling_percent, rows: int = 3) -> DataFrame:
    """``anomaly.rolling_deviation`` over the order of all rows: nulls if the whole table has fewer than ``rows`` rows."""
    own = Window.partitionBy("__part").orderBy("__halo_last", *(F.col(c).asc_nulls_first() for c in order)).rowsBetween(-(rows - 1), 0)
    parts = ranged(df, order)
    enough = parts.limit(rows).count() == rows
    held = with_halo(parts, order, rows - 1).withColumn("__halo_last", ~F.col("__halo"))
    mean = F.avg(value).over(own) if enough else F.lit(None).cast("double")
    return deviating(held.withColumn("rolling_mean", mean).where("NOT __halo").drop("__part", "__halo", "__halo_last"), value, percent)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, take: list[str], strict: bool = False, prefix: str = "last_") -> DataFrame:
    """``left`` with the columns ``take`` of the last row of ``right`` with its key at or (``strict``) before its time.

    Both sides have ``key``, ``at`` and ``tie``, which decides among rows of ``right`` at one time (the greatest counts).
    The sides are put in one order of key and time, in ranges that divide any key, and the last value is carried on,
    within a range by a window, between ranges by one value for each key and range. Nothing is multiplied.
    """
    first, second = (0, 1) if strict else (1, 0)
    value = F.struct(F.col(tie).alias("__t"), *take)
    told = [F.col(key).alias("__k"), F.col(at).alias("__at")]
    one = left.select(*told, F.lit(first).alias("__side"), F.lit(None).cast(left.schema[tie].dataType).alias("__tie"), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__value"))
    two = right.where(F.col(at).isNotNull()).select(*told, F.lit(second).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).alias("__row"), value.alias("__value"))
    parts = ranged(one.unionByName(two), ["__k", "__at", "__side", "__tie"])
    order = Window.partitionBy("__part", "__k").orderBy(*(F.col(c).asc_nulls_first() for c in ("__at", "__side", "__tie")))
    carried = parts.withColumn("__own", F.last("__value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct("__at", "__tie")
    ends = parts.groupBy("__k", "__part").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), rank)).alias("__end"))
    before = Window.partitionBy("__k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(F.col("__k").alias("__hk"), F.col("__part").alias("__hp"), F.last("__end", ignorenulls=True).over(before).alias("__handed")).where("__handed IS NOT NULL")
    mine = carried.where("__row IS NOT NULL").join(handed, F.col("__k").eqNullSafe(F.col("__hk")) & (F.col("__part") == F.col("__hp")), "left")
    last = F.when(F.col("__at").isNotNull() & F.col("__k").isNotNull(), F.coalesce("__own", "__handed"))
    return mine.select("__row.*", *(last[c].alias(f"{prefix}{c}") for c in take))


def recency(df: DataFrame, key: str, at: str, tie: str, amount: str) -> DataFrame:
    """Add days_since and amount_change: from the row's last earlier one of its key (strictly before it in time).

    amount_change is relative to the earlier amount, null where that is zero. Not a behaviour of the contract's code.
    """
    held = as_of(df, df, key, at, tie, [at, amount], strict=True, prefix="__last_")
    days = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(f"__last_{at}").cast("timestamp"))) / F.lit(86_400_000_000)
    change: Column = F.try_divide(F.col(amount) - F.col(f"__last_{amount}"), F.abs(F.col(f"__last_{amount}")))
    return held.withColumns({"days_since": days, "amount_change": change}).drop(f"__last_{at}", f"__last_{amount}")
