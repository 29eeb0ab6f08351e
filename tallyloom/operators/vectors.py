"""Names that are alike by their letters: cosines of hashed letter-group vectors, joined without a product of all names.

Specified as an embedding term by the contract's documents but not done by its code: see README. The vectors are not
learned: component ``crc32(group) % size`` counts a letter group of the lower-cased name, framed by blanks.

A name sends the rare components of its vector, in the order of how many names have a component, up to where the rest is
too short to reach the threshold: two names that reach it share such a component of both. Candidates are verified on the
whole vectors.

Defined results: names are distinct texts, null and blank ones are left out; each pair comes once, in order; a pair whose
cosine is exactly the threshold (within 1e-9) counts; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut

SIZE = 1 << 16


def vectors_of(df: DataFrame, name: str, size: int = SIZE) -> DataFrame:
    """(name, c, w): the components of every distinct name's unit vector."""
    plain = F.lower(F.col(name))
    framed = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    groups = F.regexp_extract_all(framed, F.lit("(?s)(?=(.{3}))"), F.lit(1))
    rows = df.where(F.trim(F.col(name)) != "").select(F.col(name).alias("name")).distinct().withColumnRenamed("name", name)
    counts = rows.select(F.col(name).alias("name"), F.explode(F.transform(groups, lambda g: (F.crc32(g.cast("binary")) % size).cast("int"))).alias("c")).groupBy("name", "c").agg(F.count("*").cast("double").alias("n"))
    return counts.withColumn("w", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("name")))).drop("n")


def candidates(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: pairs of names that share a component of both prefixes."""
    often = vectors.groupBy("c").agg(F.count("*").alias("often"))
    ranked = vectors.join(often, "c")
    rest = Window.partitionBy("name").orderBy("often", "c").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    prefix = cut(ranked.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).where(F.col("rest") >= least - 1e-9).select("name", "c"))
    other = prefix.select(F.col("name").alias("b"), "c")
    return prefix.withColumnRenamed("name", "a").join(other, "c").where("a < b").select("a", "b").distinct()


def alike(df: DataFrame, name: str = "vendor", least: float = 0.6, size: int = SIZE) -> DataFrame:
    """(a, b, cosine), a < b: all pairs of distinct names whose vectors' cosine is at least ``least``."""
    vectors = cut(vectors_of(df, name, size))
    whole = vectors.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("c", "w"))).alias("v"))
    pairs = candidates(vectors, least).join(whole.select(F.col("name").alias("a"), F.col("v").alias("x")), "a").join(whole.select(F.col("name").alias("b"), F.col("v").alias("y")), "b")
    both = F.map_zip_with("x", "y", lambda _, p, q: p * q)
    cosine = F.aggregate(F.map_values(both), F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))
    return pairs.select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= least - 1e-9)
