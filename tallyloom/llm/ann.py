"""Approximate nearest neighbours by a hash-prefix forest.

Every vector has one long bit string per tree: signs of its products with the tree's random directions. Vectors are held
in blocks; in a block each tree is the sorted array of the bit strings. A query descends every tree to its longest
matching prefix and then all trees ascend together, one bit at a time, until their prefix ranges hold enough different
candidates: ``factor * n ** power`` of the block's n vectors, one law at every size. The exact cosine orders them, and the
best of all blocks are merged.

The query set is stated (a condition on the id); its groups meet all blocks of the index, and a group and a block are one
task's work, so nothing grows with a hot bucket. A block's forest is built once for all queries of a group. Vectors that are equal, component by component, are indexed once with their
``k + 1`` smallest ids, which are all that a list of ``k`` can show.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinite component take no part, as queries
and as candidates, and those of another length than the query are never its candidates; ties go to the smaller id; rows
that repeat an id and vector count once; fewer candidates than k give fewer rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of the index; queries in a group, and of these at a time.
INDEX_BLOCK, QUERY_BLOCK, AT_ONCE = 32_768, 65_536, 1_024
PAIR_SCHEMA = "query_id long, vec_id long, score double"


def directions(tree: int, bits: int, size: int) -> np.ndarray:
    return np.random.default_rng(1_000_003 * tree + size).standard_normal((size, bits))


class Forest:
    """Sorted bit strings of one block of unit vectors, for every tree."""

    def __init__(self, unit: np.ndarray, trees: int, bits: int) -> None:
        self.bits, self.trees = bits, []
        for t in range(trees):
            codes = self.codes(unit, t)
            order = np.argsort(codes, kind="stable").astype(np.int32)
            self.trees.append((codes[order], order))

    def codes(self, unit: np.ndarray, tree: int) -> np.ndarray:
        signs = unit @ directions(tree, self.bits, unit.shape[1]) > 0
        return signs @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int32))

    def ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) in every tree of the entries that share ``depth`` bits with each code; codes: (trees, queries)."""
        free = (1 << (self.bits - depth)) - 1
        low = np.stack([np.searchsorted(tree, c & ~free, side="left") for (tree, _), c in zip(self.trees, codes, strict=True)])
        return low, np.stack([np.searchsorted(tree, c | free, side="right") for (tree, _), c in zip(self.trees, codes, strict=True)])

    def candidates(self, unit: np.ndarray, wanted: int) -> list[np.ndarray]:
        """Positions for every query, ``wanted`` of them or a little more (all there are, if fewer).

        Each tree is descended to its longest match. Then all trees ascend one bit at a time; at the level where their
        ranges come to hold enough different entries, the last trees are left one bit deeper.
        """
        codes = np.stack([self.codes(unit, t) for t in range(len(self.trees))])
        size = len(self.trees[0][1])
        wanted = min(wanted, size)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(unit)
        open_, (low, high) = np.arange(len(unit)), self.ranges(codes, self.bits)
        for depth in range(self.bits - 1, -1, -1):
            if not len(open_):
                break
            wide_low, wide_high = self.ranges(codes[:, open_], depth)
            enough = (wide_high - wide_low).sum(axis=0) >= wanted
            still = ~enough
            for k in np.flatnonzero(enough).tolist():
                mark, found = np.zeros(size, bool), 0
                for t, (_, order) in enumerate(self.trees):
                    mark[order[low[t, k] : high[t, k]]] = True
                found = int(mark.sum())
                for t, (_, order) in enumerate(self.trees):
                    if found >= wanted:
                        break
                    at = order[wide_low[t, k] : wide_high[t, k]]
                    at = at[~mark[at]]
                    mark[at] = True
                    found += len(at)
                still[k] = found < wanted
                if found >= wanted:
                    out[int(open_[k])] = np.flatnonzero(mark)
            open_, low, high = open_[still], wide_low[:, still], wide_high[:, still]
        return out


def _units(rows: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(rows, np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    return x, norms


def search(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = 128, bits: int = 24, factor: float = 2.7, power: float = 0.75, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score). ``factor``, ``power``: of how many vectors of a block a query is held against.

    More candidates find more of the true neighbours; the README has measured recalls.
    """
    clean = vectors.select(F.col(key).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = clean.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    clean = clean.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero, not two
    code, size = F.xxhash64("v"), F.size("v")
    # the k + 1 smallest ids of equal vectors: a partial row_number keeps at most that many in every task
    equal = clean.select("vec_id", "v", size.alias("size")).distinct().withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    index = equal.groupBy("v", "size").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    total, asked = clean.count(), clean.where("q").count()
    blocks, groups = max(1, -(-total // INDEX_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    left = clean.where("q").select("vec_id", "v").distinct().select(F.lit(1).alias("is_query"), F.array("vec_id").alias("ids"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.size("v").alias("size"))
    right = index.select(F.lit(0).alias("is_query"), "ids", "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(code, F.lit(blocks)).cast("int").alias("b"), "size")

    def meet(group: pa.Table) -> pa.Table:
        query = group.filter(pc.equal(group.column("is_query"), 1))
        store = group.filter(pc.equal(group.column("is_query"), 0))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if query.num_rows and store.num_rows:
            asks, norms = _units(query.column("v").to_pylist())
            held, lengths = _units(store.column("v").to_pylist())
            ids, queries = store.column("ids").to_pylist(), [x[0] for x in query.column("ids").to_pylist()]
            unit, asked_unit = held / lengths[:, None], asks / norms[:, None]
            forest, wanted = Forest(unit, trees, bits), int(factor * len(held) ** power) + 1
            found = (at for s in range(0, len(asks), AT_ONCE) for at in forest.candidates(asked_unit[s : s + AT_ONCE], wanted))
            for q, at in enumerate(found):
                close = unit[at] @ asked_unit[q]
                if len(at) > k + 1:
                    edge = np.partition(close, len(at) - k - 1)[len(at) - k - 1]
                    at = at[close >= edge - 1e-9]
                exact = (held[at] * asks[q]).sum(axis=1) / (lengths[at] * norms[q])  # the same for equal vectors, wherever they stand
                pairs = sorted((-s, i) for s, a in zip(exact.tolist(), at.tolist(), strict=True) for i in ids[a] if i != queries[q])[:k]
                out += [(queries[q], i, -s) for s, i in pairs]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    found = left.unionByName(right).groupBy("g", "b", "size").applyInArrow(meet, PAIR_SCHEMA).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
