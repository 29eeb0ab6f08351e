"""Merkle manifest of a data set: one hash tree for each group of rows, one over the groups' roots, a proof for each row.

Leaves are numbered by a range partition (ids ascend, whole groups of any size are divided), gathered into aligned blocks
of ``3 ** 5`` leaves and hashed level by level: the digests of a block are one contiguous matrix of 64 hexadecimal bytes a row,
which is reshaped so that a row holds the nodes of a run, and each row is hashed. The roots of blocks are the leaves of
the next round, until every tree has one block. No task holds more than some blocks, however large a tree is.

Proofs are made from the top down: a block learns the siblings above it, and the siblings within it are slices of its
matrices whose borders are index arithmetic (node ``i // 3 ** level``, run ``node // 3``). A proof is an array of
``left`` and ``right`` siblings, one entry for each level; ``folded`` hashes a leaf up along it in a column expression.

Defined results: ids ascend with nulls first, rows that repeat an id follow by leaf, and rows alike in all are
neighbours; a null group is a group of its own, before all others; null fields are ``-``; a group of one row has its
leaf as root and a proof of the levels above it; texts of any length are hashed whole; an empty table gives an empty
table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyloom.llm.common import save, small_batches

#: Children of a node; levels of a block.
FANOUT, LEVELS = 3, 5
STEP = "struct<left:string,right:string>"


# ------------------------------------------------------------------------------------------------- columns


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root to which a leaf and its siblings lead."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


# --------------------------------------------------------------------------------------- digest matrices of a block


def matrix(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)


def level_above(nodes: np.ndarray) -> np.ndarray:
    """Hashes of every run of FANOUT rows; the last run may be shorter."""
    whole = len(nodes) // FANOUT * FANOUT
    runs = [*np.ascontiguousarray(nodes[:whole]).reshape(-1, FANOUT * 64), *([nodes[whole:].ravel()] if whole < len(nodes) else [])]
    return matrix([hashlib.sha256(r).hexdigest() for r in runs])


def levels_of(leaves: np.ndarray, size: int, levels: int) -> list[np.ndarray]:
    """Matrices from the leaves to the top of a block. A tree (of ``size``) that is one block ends where one node is left;
    other blocks go exactly ``levels`` up, as the whole tree does."""
    found, alone = [leaves], size <= FANOUT**levels
    while len(found[-1]) > 1 if alone else len(found) <= levels:
        found.append(level_above(found[-1]))
    return found


def spans(nodes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Rows start..stop of a matrix as one text each."""
    size = stop - start
    ends = np.cumsum(size)
    rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
    borders = np.r_[0, ends] * 64
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(nodes[rows]))]).cast(pa.string())


def proofs_within(leaves: np.ndarray, size: int, levels: int) -> pa.Array:
    """list<struct<left, right>> for each leaf: its siblings at every level of the block."""
    found = levels_of(leaves, size, levels)
    high, sizes = len(found) - 1, np.array([len(x) for x in found])
    node = np.arange(len(leaves))[:, None] // FANOUT ** np.arange(high)[None, :]
    first = node - node % FANOUT
    last = np.minimum(first + FANOUT, sizes[None, :high])
    base = np.r_[0, np.cumsum(sizes)][:high][None, :]
    stacked = np.concatenate(found)
    left, right = spans(stacked, (first + base).ravel(), (node + base).ravel()), spans(stacked, (node + 1 + base).ravel(), (last + base).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1) * high, pa.int32()), pa.StructArray.from_arrays([left, right], names=["left", "right"]))


# --------------------------------------------------------------------------------------------- trees as tables


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes (tree, ..., digest) with ``pos`` in their tree by ``order``, digest, and ``size``, the tree's nodes.

    Ranges of (tree, order) divide any tree; a range's rows are numbered on their own and shifted by the ranges before.
    """
    by = [F.col(c).asc_nulls_first() for c in (*order, "digest", "__tie")]
    first = save(nodes.withColumn("__tie", F.monotonically_increasing_id()), "leaves")
    placed = save(first.repartitionByRange(F.col("tree"), *by).withColumn("part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    within = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*by))
    return placed.withColumn("within", within).join(shifts, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("within") - 1).drop("__tie", "part", "within", "before")


def blocks_of(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, block, size, items, top): the nodes of aligned blocks in order, and the hash of each block."""
    others = [c for c in nodes.columns if c not in ("tree", "pos", "size")]
    packed = nodes.groupBy("tree", F.floor(F.col("pos") / FANOUT**levels).alias("block")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("pos", *others))).alias("items"))
    packed = packed.withColumn("digests", F.col("items.digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            tops = [levels_of(matrix(d), n, levels)[-1].tobytes().decode() for d, n in zip(column.pop("digests").to_pylist(), column["size"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*column.values(), pa.array(tops, pa.string())], names=[*column, "top"])

    return packed.mapInArrow(run, StructType([*packed.drop("digests").schema.fields, StructField("top", StringType())]))


def climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Block tables from the leaves upward, and the root of every tree (tree, top)."""
    rounds, block = [], FANOUT**levels
    while True:
        rounds.append(save(blocks_of(nodes, levels), "blocks"))
        if (rounds[-1].agg(F.max("size")).first()[0] or 0) <= block:
            break
        nodes = rounds[-1].where(F.col("size") > block).select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / block).alias("size"), F.col("top").alias("digest"))
    return rounds, reduce(DataFrame.unionByName, (r.where(F.col("size") <= block).select("tree", "top") for r in rounds))


def opened(blocks: DataFrame, levels: int) -> DataFrame:
    """Blocks (with ``upper``, the proof above them) as one row for each node: (tree, item, proof, other columns)."""
    told = [c for c in blocks.columns if c not in ("tree", "block", "size", "items", "top", "upper")]
    known = blocks.select("tree", "size", "items", F.col("items.digest").alias("digests"), "upper", *told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i, (digests, size) in enumerate(zip(column.pop("digests").to_pylist(), column["size"].to_pylist(), strict=True)):
                proofs = proofs_within(matrix(digests), size, levels)
                within = pa.ListArray.from_arrays(pa.array([0, len(proofs)], pa.int32()), proofs)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in column.values()), within], names=[*column, "within"])

    schema = StructType([*known.drop("digests").schema.fields, *StructType.fromDDL(f"within array<array<{STEP}>>").fields])
    rows = known.mapInArrow(run, schema).select("tree", F.explode(F.arrays_zip("items", "within")).alias("__one"), "upper", *told)
    return rows.select("tree", F.col("__one.items").alias("item"), F.concat("__one.within", "upper").alias("proof"), *told)


def descend(rounds: list[DataFrame], trees: DataFrame, levels: int) -> DataFrame:
    """Every leaf with its proof up to the top of ``trees`` (tree, upper, other columns; one row a tree)."""
    above, block = None, FANOUT**levels
    for blocks in reversed(rounds):
        known = blocks.where(F.col("size") <= block).join(trees, "tree")
        if above is not None:
            known = known.unionByName(blocks.where(F.col("size") > block).join(above, ["tree", "block"]))
        rows = opened(known, levels)
        above = rows.select("tree", F.col("item.pos").alias("block"), F.col("proof").alias("upper"), *(c for c in trees.columns if c not in ("tree", "upper")))
    return rows


def prove(docs: DataFrame, fields: tuple[str, ...], key: str = "doc_id", group: str = "source", changed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, changed_leaf, subroot, root, proof) of every row.

    changed: values of some fields as they are found later; ``folded(changed_leaf, proof)`` equals the root only where
    they are the same. A proof leads from the leaf by way of the group's root to the root of all. levels: of a block, which
    changes no result.
    """
    small_batches(docs.sparkSession)
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    now = leaf([(changed or {}).get(c, F.col(c)) for c in fields])
    leaves = docs.select(tree.alias("tree"), F.col(key).alias("__key"), leaf([F.col(c) for c in fields]).alias("digest"), now.alias("__changed"))
    rounds, roots = climb(numbered(leaves, ["__key"]), levels)
    tops, root = climb(numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("__group"), F.col("top").alias("digest")), ["__group"]), levels)
    nothing = F.array().cast(f"array<{STEP}>")
    groups = save(descend(tops, root.select("tree", nothing.alias("upper"), F.col("top").alias("root")), levels).select(F.col("item.__group").alias("tree"), F.col("proof").alias("upper"), F.col("item.digest").alias("subroot"), "root"), "groups")
    return descend(rounds, groups, levels).select(F.col("item.__key").alias(key), F.col("item.digest").alias("leaf"), F.col("item.__changed").alias("changed_leaf"), "subroot", "root", "proof")


def digests(docs: DataFrame, key: str = "doc_id", group: str = "source", text: str = "text", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), modulus: int = 2, levels: int = LEVELS) -> DataFrame:
    """Proofs of all rows against copies that lost the line ends of their text where crc32 of the id is divisible by ``modulus``.

    (key, leaf, subroot, root, proof_sha256, folded_root, verified).
    """
    hit = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == 0
    proven = prove(docs, fields, key, group, {text: F.when(hit, F.translate(text, "\n", "")).otherwise(F.col(text))}, levels)
    rows = proven.select(key, "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded(F.col("changed_leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
