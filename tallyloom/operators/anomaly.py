"""Statistical anomalies: z-scores, rolling deviations, isolation forest, and the combined score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyloom.config import AUDIT
from tallyloom.functions import text as T
from tallyloom.session import cut


def _z(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (x - mean) / std).otherwise(F.lit(0.0))


def global_outliers(df: DataFrame, value: str, sigma: float = AUDIT.sigma_global) -> DataFrame:
    """Add z_score and is_outlier against mean and sample deviation of all rows (one row, broadcast)."""
    stats = F.broadcast(df.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s")))
    z = F.coalesce(_z(F.col(value), F.col("__m"), F.col("__s")), F.lit(0.0))
    return df.crossJoin(stats).withColumn("z_score", z).withColumn("is_outlier", F.abs("z_score") > sigma).drop("__m", "__s")


def vendor_profiles(df: DataFrame, vendor: str, value: str) -> DataFrame:
    return df.groupBy(vendor).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("frequency"))


def vendor_outliers(df: DataFrame, profiles: DataFrame, vendor: str, value: str, sigma: float = AUDIT.sigma_vendor) -> DataFrame:
    """Add z_score and is_outlier against the vendor's profile; without a profile a row is no outlier."""
    z = F.coalesce(_z(F.col(value), F.col("mean"), F.col("std")), F.lit(0.0))
    return df.join(profiles.select(vendor, "mean", "std"), vendor, "left").withColumn("z_score", z).withColumn("is_outlier", F.abs("z_score") > sigma).drop("mean", "std")


def rolling_deviation(df: DataFrame, order: list[str], value: str, by: list[str], percent: float = AUDIT.rolling_percent, rows: int = 3) -> DataFrame:
    """Add rolling_mean over the row and up to ``rows - 1`` before it, deviation_pct and is_deviation, for each ``by``.

    Groups of fewer than ``rows`` rows have nulls; in others the first rows are held against what there is before them.
    The work of a group is one task's; ``ordered.rolling_deviation`` takes the order over all rows.
    """
    w = Window.partitionBy(*by)
    mean = F.when(F.count("*").over(w) >= rows, F.avg(value).over(w.orderBy(*order).rowsBetween(-(rows - 1), 0)))
    return deviating(df.withColumn("rolling_mean", mean), value, percent)


def deviating(df: DataFrame, value: str, percent: float) -> DataFrame:
    """Add deviation_pct from ``rolling_mean`` and is_deviation; from a mean of zero any other value deviates infinitely."""
    off = F.abs(F.col(value) - F.col("rolling_mean"))
    pct = F.when(F.col("rolling_mean") == 0, F.when(off > 0, F.lit(float("inf")))).otherwise(off / F.abs("rolling_mean") * 100)
    return df.withColumn("deviation_pct", pct).withColumn("is_deviation", F.coalesce(F.col("deviation_pct") > percent, F.lit(False)))


def combined_score(df: DataFrame) -> DataFrame:
    """Add anomaly_score (at most 100), reasons and high_risk from four boolean signals; null counts as false."""
    # Signal, weight, reason.
    weights = [("is_anomaly_if", 30, "isolation_forest"), ("is_vendor_outlier", 30, "vendor_outlier"), ("is_amount_outlier", 20, "amount_outlier"), ("is_time_series_deviation", 20, "time_series_deviation")]
    on = {c: F.coalesce(F.col(c), F.lit(False)) for c, _, _ in weights}
    score = sum((F.when(on[c], w).otherwise(0) for c, w, _ in weights), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(on[c], F.lit(r)) for c, _, r in weights]))
    return df.withColumn("anomaly_score", F.least(score, F.lit(100))).withColumn("reasons", reasons).withColumn("high_risk", F.col("anomaly_score") > 70)


# --------------------------------------------------------------------------------------------- isolation forest


def _path_norm(n: float) -> float:
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)


def grow_forest(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> list[list[tuple]]:
    """Isolation trees on subsamples; a tree is a list of nodes (feature, cut, left, right) or (-1, depth + norm).

    x: rows in random order. Where they suffice every tree has rows of its own.
    """
    draw, out = np.random.default_rng(seed), []
    for t in range(trees):
        nodes: list[tuple] = []
        limit = int(np.ceil(np.log2(max(2, min(sample, len(x))))))

        def build(rows: np.ndarray, depth: int, nodes: list[tuple] = nodes, limit: int = limit) -> int:
            at = len(nodes)
            nodes.append(())
            span = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) else np.zeros(x.shape[1])
            open_ = np.flatnonzero(span > 0)
            if depth >= limit or len(rows) <= 1 or not len(open_):
                nodes[at] = (-1, depth + _path_norm(len(rows)), 0, 0)
                return at
            k = int(draw.choice(open_))
            cut = float(draw.uniform(x[rows, k].min(), x[rows, k].max()))
            below = x[rows, k] < cut
            left = build(rows[below], depth + 1)
            nodes[at] = (k, cut, left, build(rows[~below], depth + 1))
            return at

        own = np.arange(t * sample, (t + 1) * sample) if len(x) >= trees * sample else draw.choice(len(x), size=min(sample, len(x)), replace=False)
        build(own, 0)
        out.append(nodes)
    return out


def forest_scores(forest: list[list[tuple]], x: np.ndarray, sample: int) -> np.ndarray:
    depth = np.zeros(len(x))
    for nodes in forest:
        feature, value, left, right = (np.array([n[i] for n in nodes]) for i in range(4))
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            node = at[inner]
            below = x[inner, feature[node].astype(int)] < value[node]
            at[inner] = np.where(below, left[node], right[node])
        depth += value[at]
    return 2.0 ** (-depth / len(forest) / max(_path_norm(sample), 1e-9))


def isolation_forest(df: DataFrame, ident: str, amount: str, date: str, vendor: str, contamination: float = AUDIT.contamination, below: float = AUDIT.decision_below, trees: int = 100, sample: int = 256) -> DataFrame:
    """Add isolation_score (0 to 1), decision_score and is_anomaly_if: decision_score < ``below``.

    The decision score is the contamination quantile of the scores less the row's score, so that part of the rows has
    one below 0; the contract's limit of -0.5 flags far fewer. Every tree's ``sample`` rows are drawn from all rows, by
    least id hash; every row is scored, once, and written to the checkpoint folder.
    """
    rows = df.withColumn("__f", F.array(*T.calendar_features(F.coalesce(F.col(amount), F.lit(0.0)), F.col(date), F.col(vendor)))).withColumn("__f", F.transform("__f", lambda v: F.coalesce(v, F.lit(0.0))))
    fit = rows.orderBy(F.xxhash64(ident), ident).limit(trees * sample).select("__f").toPandas()["__f"]
    if not len(fit):
        return df.withColumns({"isolation_score": F.lit(None).cast("double"), "decision_score": F.lit(None).cast("double"), "is_anomaly_if": F.lit(False)})
    x = np.stack(fit.to_numpy())
    forest, sample = grow_forest(x, trees, sample), min(sample, len(x))

    @F.pandas_udf(DoubleType())
    def scores(features: pd.Series) -> pd.Series:
        return pd.Series(forest_scores(forest, np.stack(features.to_numpy()), sample))

    scored = cut(rows.withColumn("isolation_score", scores("__f")).drop("__f"))
    quantile = F.broadcast(scored.agg(F.percentile_approx("isolation_score", 1 - contamination, 10_000).alias("__cut")))
    return scored.crossJoin(quantile).withColumn("decision_score", F.col("__cut") - F.col("isolation_score")).withColumn("is_anomaly_if", F.col("decision_score") < below).drop("__cut")


def seasonal_naive(df: DataFrame, vendor: str, date: str, late_days: int = 5) -> DataFrame:
    """Recurring vendors: expected next day from the median gap, and whether the data ends later than that allows."""
    days = df.select(vendor, F.to_date(date).alias("day")).distinct()
    w = Window.partitionBy(vendor).orderBy("day")
    gaps = days.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    last = F.broadcast(days.agg(F.max("day").alias("end")))
    per = gaps.groupBy(vendor).agg(F.count("*").alias("n"), F.percentile("gap", 0.5).alias("gap"), F.max("day").alias("last"))
    return per.crossJoin(last).where("n >= 3").select(vendor, "n", "gap", "last", (F.datediff("end", "last") > F.col("gap") + late_days).alias("is_late"))
