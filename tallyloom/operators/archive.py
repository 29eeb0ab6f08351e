"""An archive that shows any change: log entries as leaves of one hash tree, built level by level.

Specified by the contract's documents, whose code has the retention constant alone: see README.

Entries are numbered in order of time and id by ranges; every level is one grouped aggregate over positions, so no task
holds more than ``WIDE`` nodes of one parent. The nodes of all levels are one table (level, pos, digest); its last level
is the root. Purged entries leave their nodes behind: what remains is still proved by the same root.

Defined results: null columns are told apart from empty ones; entries that are alike in order and content are
neighbours; an empty log has no nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordered import ranged
from tallyloom.session import cut

#: Children of a node.
WIDE = 16


def entry_digest(columns: list[str]) -> Column:
    """sha256 of an entry: length and value of each column, ``-`` for null."""
    shown = [F.col(c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in shown)), 256)


def sealed(log: DataFrame, order: list[str]) -> DataFrame:
    """``log`` with ``archive_pos``, its place in order, and ``archive_digest``."""
    rows = ranged(log.withColumn("archive_digest", entry_digest(log.columns)), [*order, "archive_digest"])
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))
    shifts = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row a range
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*(F.col(c).asc_nulls_first() for c in order), "archive_digest"))
    return cut(rows.withColumn("__n", within).join(shifts, "__part").withColumn("archive_pos", F.col("__before") + F.col("__n") - 1).drop("__part", "__n", "__before"))


def nodes(entries: DataFrame) -> DataFrame:
    """(level, pos, digest) of the whole tree over sealed entries."""
    level = entries.select(F.lit(0).alias("level"), F.col("archive_pos").alias("pos"), F.col("archive_digest").alias("digest"))
    found, size = [level], level.count()
    while size > 1:
        child = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        parents = found[-1].groupBy((F.floor(F.col("pos") / WIDE)).alias("parent")).agg(child.alias("c"))
        found.append(cut(parents.select(F.lit(len(found)).alias("level"), F.col("parent").alias("pos"), F.sha2(F.array_join(F.transform("c", lambda x: x["digest"]), ""), 256).alias("digest"))))
        size = -(-size // WIDE)
    return reduce(DataFrame.unionByName, found)


def changed(kept: DataFrame, now: DataFrame) -> tuple[DataFrame, int]:
    """(pos of the entries that differ, levels that were read): from the root down, only under nodes that differ."""
    top = kept.agg(F.max("level")).first()[0]
    if top is None:
        return now.where("level = 0").select("pos"), 0
    suspects, read = kept.where(F.col("level") == top).select("pos"), 0
    for level in range(top, -1, -1):
        one = kept.where(F.col("level") == level).select("pos", "digest")
        two = now.where(F.col("level") == level).select("pos", F.col("digest").alias("other"))
        suspects = cut(suspects.join(one, "pos").join(two, "pos", "left").where("NOT digest <=> other").select("pos"))
        read += 1
        if level and suspects.isEmpty():
            return suspects, read
        if level:
            suspects = suspects.select(F.explode(F.sequence(F.col("pos") * WIDE, F.col("pos") * WIDE + WIDE - 1)).alias("pos"))
    return suspects, read


def still_proved(kept: DataFrame, remaining: DataFrame) -> bool:
    """Do the remaining entries, with the kept nodes of those that were purged, lead to the kept root?"""
    top = kept.agg(F.max("level")).first()[0]
    if top is None:
        return remaining.isEmpty()
    leaves = kept.where("level = 0").select("pos", "digest")
    mine = remaining.select(F.col("archive_pos").alias("pos"), F.col("archive_digest").alias("mine"))
    entries = leaves.join(mine, "pos", "full_outer").select(F.col("pos").alias("archive_pos"), F.coalesce("mine", "digest").alias("archive_digest"))
    root = lambda t: t.where(F.col("level") == top).select("digest").collect()  # noqa: E731  one row
    return root(nodes(entries)) == root(kept)
