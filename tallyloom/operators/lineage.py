"""Where a link has gone: chains of supersession followed to their newest version by pointer jumping.

Not a behaviour of the contract's code, which closes a version and names its successor but never follows the names.

Defined results: a version without a successor, or whose successor is no version, is its own newest at distance 0; of a
version with several successors the least id counts; versions whose chain ends in a cycle have a null newest version and
``in_cycle`` true; null ids are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut


def newest(links: DataFrame, ident: str = "link_id", successor: str = "superseded_by") -> DataFrame:
    """(link_id, newest_id, distance, in_cycle) of every version.

    In each round every pointer jumps to where its target points, so a chain of n versions takes log2(n) rounds of one
    equi-join. Pointers that still move when more steps were made than there are versions run in a cycle.
    """
    own = links.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("id")).agg(F.min(successor).alias("next"))
    known = own.select(F.col("id").alias("next"))
    linked = own.join(known, "next", "left_semi").select("id", "next")
    state = cut(own.select("id").join(linked, "id", "left").select("id", F.coalesce("next", "id").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    versions = state.count()
    while True:
        target = state.select(F.col("id").alias("to"), F.col("to").alias("__to"), F.col("steps").alias("__steps"))
        jumped = cut(state.join(target, "to").select("id", F.col("__to").alias("to"), (F.col("steps") + F.col("__steps")).alias("steps"), (F.col("__steps") > 0).alias("moved")))
        moving = jumped.where("moved").agg(F.count("*").alias("n"), F.max("steps").alias("most")).first()
        state = jumped.drop("moved")
        if not moving["n"]:
            break
        if moving["most"] > 2 * versions:  # chains have ended a round ago: what still moves will always do
            cyclic = jumped.where("moved").select("id").withColumn("in_cycle", F.lit(True))
            state = state.join(cyclic, "id", "left")
            return state.select(F.col("id").alias(ident), F.when(F.col("in_cycle").isNull(), F.col("to")).alias("newest_id"), F.when(F.col("in_cycle").isNull(), F.col("steps")).alias("distance"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
    return state.select(F.col("id").alias(ident), F.col("to").alias("newest_id"), F.col("steps").alias("distance"), F.lit(False).alias("in_cycle"))
