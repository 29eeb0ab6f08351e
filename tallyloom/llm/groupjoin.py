"""Set-similarity self-join over word n-grams by a grouped prefix join, with the classes its links form.

1. A document's set is its distinct shingles; equal sets are one class from the start. Document frequencies of all
   shingles are counted over all classes; the global order is rare first, then by hash.
2. Two sets of the wanted similarity share a shingle in their prefixes (the first n - ceil(t n) + 1 in order). A prefix
   shingle that no other class has is dropped; a document left with none has no partner.
3. Classes with identical prefix and size are collapsed into one group; groups meet in their shingles' postings, where
   length and position filters hold off pairs that cannot reach the threshold.
4. Surviving group pairs are expanded to classes and verified on the whole sets, exactly against the threshold.

No group of near copies is expanded to all pairs. Round one pairs each class with one leader (the earliest class of the
postings they share most) and contracts what is verified. Round two takes every remaining pair of a posting whose sides
are in different components, so no link between components is lost: first the heads of the entries are verified, then
those members that the symmetric differences to their heads leave within reach of each other. Components come from
alternating large-star and small-star steps on written tables.

Shingles that more than ``CROWD`` classes have carry a sketch of the set: the parity of its shingles in each of ``BITS``
cells. Two sketches differ in no more cells than their sets differ in shingles, so pairs whose sketches differ too much
for a link are left out and none is lost. Where more than ``FEW`` pairs an entry are left in a posting, each entry first
gives the pair nearest by sketch alone; what is verified is contracted, and the postings are gone through again, until
none has too many or no link is found. The last pass always takes every pair that is left. On sets of much over ``BITS``
/ 4 shingles sketches part less, and more pairs are left.

A posting of more than ``HOT`` entries is divided by a hash of the entry: each part has a leader of its own, and each
pair of parts is one tile of round two, unless all entries of both are in one component: these are not sent at all, so a
posting of one component costs nothing. A tile meets at most ``HOT`` squared pairs. The driver holds one number for each
part of a hot posting, at most 2 / ``HOT`` of all entries. Copies meet by block and class, so a class of any size is one
row a block.

64-bit hashes stand for shingles. Defined results: null and empty texts, and texts of white space, have empty sets, link
with nothing and are their own component; below five words the whole sequence is the one shingle; ids are integers; rows
that repeat an id are one document with the links of all its texts, and so are the rows without an id, which come before
all ids: theirs, and a component's that has them, is null; extra columns are ignored (``deduplicate`` keeps them); an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import COUNT_SCHEMA, RunHashes, Tokens, count_rows, each_block, expand, let_go, mix, pack_arrays, pack_blocks, parts_for, save, spread, squeeze, texts_of, told_totals, totals, trimmed, with_answers

#: Shingles in a hash range of the counting step; postings in a range of the candidate step.
SHINGLES, POSTINGS = 2_000_000, 1_000_000
#: Entries of a posting that are not divided.
HOT = 20_000
#: Entries of a posting above which sketches are compared; cells of a sketch; pairs an entry that need no contraction first;
#: passes of contraction at most.
CROWD, BITS, FEW, PASSES = 64, 2048, 4, 12
LEAST_ID = -(1 << 63)
SETS = "block long, doc_id long, n long, cls long, first boolean, lead boolean, grp long, tokens array<long>, places array<int>, often array<boolean>, sketch binary, members binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Least common shingles with which sets of sizes a and b reach the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(codes: np.ndarray) -> bytes:
    """The parity of a set's shingles in each of ``BITS`` cells."""
    cell = (mix(codes ^ _ODD) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=BITS) & 1).astype(np.uint8)).tobytes()


class Sets:
    """Shingle sets of a block's documents: document i has ``codes[ends[i-1]:ends[i]]``, ascending."""

    def __init__(self, table: pa.Table, key: str, text: str, shingle: int) -> None:
        tokens = Tokens(texts_of(table, text, lower=True))
        self.doc_id = table.column(key).cast(pa.int64()).fill_null(LEAST_ID).to_numpy()
        runs = RunHashes(tokens.hashes()[tokens.ids])
        docs = len(self.doc_id)
        sizes = tokens.ends - tokens.starts
        doc = np.repeat(np.arange(docs), sizes)
        windows = np.flatnonzero(np.arange(tokens.n) + shingle <= tokens.ends[doc]) if tokens.n else np.empty(0, np.int64)
        short = np.flatnonzero((sizes > 0) & (sizes < shingle))
        code = np.r_[runs.windows(shingle)[windows] if len(windows) else np.empty(0, np.uint64), runs.runs(tokens.starts[short], tokens.ends[short])]
        doc = np.r_[doc[windows], short]
        order = np.lexsort((code, doc))
        code, doc = code[order], doc[order]
        keep = np.r_[True, (np.diff(code) != 0) | (np.diff(doc) != 0)] if len(code) else np.empty(0, bool)
        self.codes, self.doc = code[keep], doc[keep]
        self.n = np.bincount(self.doc, minlength=docs).astype(np.int64)
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n
        total = np.zeros(docs, np.uint64)
        np.add.at(total, self.doc, mix(self.codes ^ _ODD))
        self.cls = mix(total + self.n.astype(np.uint64) * _ODD)
        # the earliest document of each class stands for it in this block
        order = np.lexsort((self.doc_id, self.cls))
        first = np.r_[True, np.diff(self.cls[order]) != 0] if docs else np.empty(0, bool)
        self.lead = np.zeros(docs, bool)
        self.lead[order[first]] = True
        self.lead &= self.n > 0

    def frequencies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ascending distinct shingles, number of the block's classes that have each, index of every entry)."""
        distinct, inverse = np.unique(self.codes, return_inverse=True)
        return distinct, np.bincount(inverse, weights=self.lead[self.doc], minlength=len(distinct)).astype(np.int64), inverse


def shingle_sets(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """One row a document (SETS): size, class, whether it is the block's first of its class, and for classes with possible
    partners group, prefix postings and set."""
    docs = docs.select(key, text)
    blocks = pack_blocks(docs, text)
    parts = parts_for(int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 7, SHINGLES)

    def count(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        distinct, counts, _ = Sets(table, key, text, shingle).frequencies()
        yield from count_rows(block, distinct, counts, parts)

    frequencies = save(totals(each_block(blocks, count, COUNT_SCHEMA), parts), "frequencies")
    let_go(docs.sparkSession)

    def finish(block: int, table: pa.Table, answer: pa.Table) -> pa.Table:
        sets = Sets(table, key, text, shingle)
        distinct, _, index = sets.frequencies()
        frequency = told_totals(answer, distinct, range(parts))[index]
        order = np.lexsort((sets.codes, frequency, sets.doc))
        codes, frequency = sets.codes[order].view(np.int64), frequency[order]
        columns: dict[str, list] = {k: [] for k in ("grp", "tokens", "places", "often", "sketch", "members")}
        lead = sets.lead.copy()
        for i, (s, e) in enumerate(zip(sets.starts.tolist(), sets.ends.tolist(), strict=True)):
            n = e - s
            end = s + n + (-percent * n // 100) + 1
            shared = np.flatnonzero(frequency[s:end] > 1) if lead[i] else ()
            lead[i] = bool(len(shared))
            columns["grp"].append(int((mix(np.array([mix(codes[s:end].view(np.uint64) ^ _ODD).sum()], np.uint64) + np.uint64(n))).view(np.int64)[0]) if lead[i] else None)
            columns["tokens"].append(codes[s:end][shared] if lead[i] else None)
            columns["places"].append(shared.astype(np.int32) if lead[i] else None)
            often = frequency[s:end][shared] > CROWD if lead[i] else None
            columns["often"].append(often)
            columns["sketch"].append(sketch(sets.codes[s:e]) if lead[i] and often.any() else None)
            columns["members"].append(squeeze(sets.codes[s:e]) if lead[i] else None)
        return pa.table(
            {
                "block": pa.array(np.full(len(sets.doc_id), block)), "doc_id": pa.array(sets.doc_id), "n": pa.array(sets.n), "cls": pa.array(sets.cls.view(np.int64)), "first": pa.array(sets.lead), "lead": pa.array(lead),
                "grp": pa.array(columns["grp"], pa.int64()), "tokens": pa.array(columns["tokens"], pa.list_(pa.int64())), "places": pa.array(columns["places"], pa.list_(pa.int32())),
                "often": pa.array(columns["often"], pa.list_(pa.bool_())), "sketch": pa.array(columns["sketch"], pa.binary()), "members": pa.array(columns["members"], pa.binary()),
            }
        )

    out = save(with_answers(blocks, frequencies, finish, SETS), "sets")
    let_go(docs.sparkSession, blocks, frequencies)
    return out


# ----------------------------------------------------------------------------------------------------- candidates


def hot_postings(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles with more than ``HOT`` entries, ascending; into how many parts each is divided)."""
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    found = sorted((r["token"], -(-r["n"] // HOT)) for r in counts.collect())
    return np.array([t for t, _ in found], np.int64), np.array([k for _, k in found], np.int64)


def hot_entries(batch: pa.RecordBatch, token: np.ndarray, row: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, which hot posting, part of it) of those entries of a batch that are in hot postings."""
    hot_token, divided = hot
    which = np.minimum(np.searchsorted(hot_token, token), len(hot_token) - 1)
    at = np.flatnonzero(hot_token[which] == token)
    which = which[at]
    ident = batch.column("id").to_numpy(zero_copy_only=False)[row[at]]
    return at, which, (mix(ident.view(np.uint64) ^ _ODD) % divided[which].astype(np.uint64)).astype(np.int64)


def hot_components(rows: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest component) of the entries of every part of the hot postings, parts numbered through."""
    first, slots = np.cumsum(hot[1]) - hot[1], int(hot[1].sum())
    low, high = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    if not slots:
        return low, high

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at, which, own = hot_entries(batch, batch.column("tokens").flatten().to_numpy(), row, hot)
            slot, comp = first[which] + own, batch.column("comp").to_numpy(zero_copy_only=False)[row[at]]
            order = np.lexsort((comp, slot))
            slot, comp = slot[order], comp[order]
            new = np.flatnonzero(np.r_[True, np.diff(slot) != 0]) if len(slot) else np.empty(0, np.int64)
            last = np.r_[new[1:], len(slot)] - 1 if len(new) else new
            yield pa.RecordBatch.from_arrays([pa.array(slot[new]), pa.array(comp[new]), pa.array(comp[last])], names=["slot", "low", "high"])

    found = rows.select("id", "comp", "tokens").mapInArrow(trimmed(ends), "slot long, low long, high long").groupBy("slot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in found.collect():
        low[r["slot"]], high[r["slot"]] = r["low"], r["high"]
    return low, high


def _in_ranges(rows: DataFrame, parts: int, work, schema: str, hot: tuple[np.ndarray, np.ndarray], tiles: bool) -> DataFrame:
    """``work(token, id, comp, n, place)`` on all postings of a range of shingles; a range has a bounded share of them.

    The parts of a hot posting are ranges of their own, or, with ``tiles``, every pair of its parts is one, but for those
    whose entries are all in one component. Rows with ``slack``, ``often`` and ``sketch`` give ``work`` slack and sketch too;
    the sketch is null where the shingle is not ``often``.
    """
    hot_token, divided = hot
    sketched = "sketch" in rows.columns
    numbers = ["id", "comp", "n", *(["slack"] if sketched else [])]
    low, high = hot_components(rows, hot) if tiles else (divided, divided)
    slots = np.cumsum(divided) - divided
    squares = divided * divided if tiles else divided
    bases = parts + np.cumsum(squares) - squares
    ranges = parts + int(squares.sum())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places = batch.column("tokens"), batch.column("places")
            sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            token, place = tokens.flatten().to_numpy(), places.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            part, entry = (token >> 33) % parts, np.arange(len(token))
            if len(hot_token) and len(token):
                at, which, own = hot_entries(batch, token, row, hot)
                cold = np.ones(len(token), bool)
                cold[at] = False
                if tiles:
                    k = divided[which]
                    other = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    at, own, which = np.repeat(at, k), np.repeat(own, k), np.repeat(which, k)
                    a, b = slots[which] + own, slots[which] + other
                    apart = np.minimum(low[a], low[b]) != np.maximum(high[a], high[b])
                    at, own, which, other = at[apart], own[apart], which[apart], other[apart]
                    own = np.minimum(own, other) * divided[which] + np.maximum(own, other)
                part, entry = np.r_[part[cold], bases[which] + own], np.r_[entry[cold], at]
            order = np.lexsort((entry, part))
            part, entry = part[order], entry[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            if not len(part):
                continue
            columns = {k: batch.column(k).to_numpy(zero_copy_only=False)[row[entry]] for k in numbers} | {"token": token[entry], "place": place[entry]}
            if sketched:
                often = batch.column("often").flatten().to_numpy(zero_copy_only=False)
                columns["sketch"] = batch.column("sketch").take(pa.array(row[entry], mask=~often[entry].astype(bool)))
            starts, stops = np.r_[0, cuts], np.r_[cuts, len(part)]
            blobs = [pack_arrays({k: v[a:b] for k, v in columns.items()}) for a, b in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def run(group: pa.Table) -> pa.Table:
        found = [pa.ipc.open_stream(b).read_all() for b in group.column("blob").to_pylist()]
        whole = pa.concat_tables(found)
        more = (whole.column("slack").to_numpy(), whole.column("sketch")) if sketched else ()
        return work(*(whole.column(k).to_numpy() for k in ("token", "id", "comp", "n", "place")), *more)

    return spread(rows.select(*numbers, "tokens", "places", *(["often", "sketch"] if sketched else [])).mapInArrow(trimmed(cut), "part int, blob binary"), ranges, "part").groupBy("part").applyInArrow(run, schema)


def leaders(percent: int):
    """Round one: of each posting the earliest entry leads; tells how many postings a member shares with a leader."""

    def work(token, ident, comp, n, place) -> pa.Table:
        order = np.lexsort((ident, token))
        token, ident, n = token[order], ident[order], n[order]
        new = np.r_[True, np.diff(token) != 0]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        small, large = np.minimum(n, n[lead]), np.maximum(n, n[lead])
        fit = (ident != ident[lead]) & (100 * small >= percent * large)
        pairs, count = np.unique(np.stack([ident[fit], ident[lead][fit]], axis=1), axis=0, return_counts=True) if fit.any() else (np.empty((0, 2), np.int64), np.empty(0, np.int64))
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "shared": pa.array(count)})

    return work


def unpacked(sketches: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(sketches as rows of uint64 words, row of each entry or -1 where it has none)."""
    there = pc.is_valid(sketches).to_numpy()
    words = np.frombuffer(b"".join(sketches.drop_null().to_pylist()), np.uint64).reshape(-1, BITS // 64)
    return words, np.where(there, np.cumsum(there) - 1, -1)


def crossing(percent: int, nearest: bool):
    """Round two: group pairs of a posting in different components that pass the length, position and sketch filters.

    With ``nearest``, a posting of more than ``FEW`` such pairs an entry gives each entry's nearest by sketch only; its pairs
    are not ``whole``. slack: what members of the group may be nearer to others than its head, in shingles.
    """

    def work(token, ident, comp, n, place, slack, sketches) -> pa.Table:
        words, at = unpacked(sketches)
        order = np.lexsort((n, token))
        token, ident, comp, n, place, slack, at = (x[order] for x in (token, ident, comp, n, place, slack, at))
        cuts = np.flatnonzero(np.diff(token)) + 1
        found: list[np.ndarray] = []
        partly: list[np.ndarray] = []
        for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(token)].tolist(), strict=True):
            if e - s < 2 or (comp[s:e] == comp[s]).all():
                continue
            crowded = e - s > CROWD and bool((at[s:e] >= 0).all())
            marks = words[at[s:e]] if crowded else None
            near, best = np.full(e - s, BITS + 1), np.full(e - s, -1)
            mine: list[np.ndarray] = []
            left = 0
            for i in range(s, e - 1):
                stop = s + int(np.searchsorted(n[s:e], 100 * n[i] // percent, side="right"))
                other = np.arange(i + 1, stop)
                least = needed(n[i], n[other], percent)
                most = 1 + np.minimum(n[i] - place[i], n[other] - place[other]) - 1
                fit = (comp[other] != comp[i]) & (most >= least)
                other, least = other[fit], least[fit]
                if crowded and len(other):
                    apart = np.bitwise_count(marks[other - s] ^ marks[i - s]).sum(axis=1, dtype=np.int64)
                    fit = apart <= n[i] + n[other] - 2 * least + slack[i] + slack[other]
                    other, apart = other[fit], apart[fit]
                if not len(other):
                    continue
                left += len(other)
                if crowded and nearest:
                    nearer = apart < near[other - s]
                    near[other[nearer] - s], best[other[nearer] - s] = apart[nearer], i
                    k = int(np.argmin(apart))
                    if apart[k] < near[i - s]:
                        near[i - s], best[i - s] = apart[k], other[k]
                    if left > FEW * (e - s):
                        mine = []
                        continue
                mine.append(np.stack([np.minimum(ident[other], ident[i]), np.maximum(ident[other], ident[i])], axis=1))
            if crowded and nearest and left > FEW * (e - s):
                one = np.flatnonzero(best >= 0)
                a, b = ident[s + one], ident[best[one]]
                partly.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
            found += mine
            if sum(map(len, found)) > 2_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
        none = np.empty((0, 2), np.int64)
        whole, part = (np.unique(np.concatenate(x), axis=0) if x else none for x in (found, partly))
        pairs = np.concatenate([whole, part])
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "whole": pa.array(np.arange(len(pairs)) < len(whole))})

    return work


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, m, common): sizes of the sets of classes a and b, and how many shingles they share."""
    whole = sets.where("lead").select(F.col("doc_id"), "n", "members")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("n", "members", "m", "others")]
            common = [len(np.intersect1d(expand(x, n), expand(y, m), assume_unique=True)) for n, x, m, y in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("a", "b", "n", "m")), pa.array(common, pa.int64())], names=["a", "b", "n", "m", "common"])

    one = pairs.join(whole.withColumnRenamed("doc_id", "a"), "a")
    both = one.join(whole.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("members").alias("others")), "b")
    return both.select("a", "b", "n", "members", "m", "others").mapInArrow(trimmed(check), "a long, b long, n long, m long, common long")


def linked(percent: int):
    """Of measured pairs, whether they reach the threshold."""
    return F.col("common") * 100 >= F.lit(percent) * (F.col("n") + F.col("m") - F.col("common"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold."""
    return measured(pairs, sets).where(linked(percent)).select("a", "b")


def between_members(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between members of entries whose heads (pairs) don't link.

    members: (id, doc_id), the members of entry ``id`` but its head. The symmetric difference of two members is at least
    that of their heads less those of each member to its head; pairs that cannot come close enough are not formed.
    """
    apart = measured(pairs, sets).where(~linked(percent)).select("a", "b", "n", "m", (F.col("n") + F.col("m") - 2 * F.col("common")).alias("gap"))
    heads = apart.select(F.col("a").alias("id")).union(apart.select("b")).distinct()
    inner = measured(members.join(heads, "id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")), sets)
    far = save(heads.select("id", F.col("id").alias("x"), F.lit(0).cast("long").alias("far")).unionByName(inner.select(F.col("a").alias("id"), F.col("b").alias("x"), (F.col("n") + F.col("m") - 2 * F.col("common")).alias("far"))), "members")
    most = far.groupBy("id").agg(F.max("far").alias("most"))
    total = F.col("n") + F.col("m")
    room = total - 2 * F.ceil(total * percent / (100 + percent)).cast("long")  # the largest difference of linked sets
    reach = apart.withColumn("gap", F.col("gap") - room).join(most.select(F.col("id").alias("a"), F.col("most").alias("most_a")), "a").join(most.select(F.col("id").alias("b"), F.col("most").alias("most_b")), "b").where("most_a + most_b >= gap AND most_a + most_b > 0")
    one = reach.join(far.select(F.col("id").alias("a"), "x", F.col("far").alias("far_x")), "a").where("far_x + most_b >= gap")
    both = one.join(far.select(F.col("id").alias("b"), F.col("x").alias("y"), F.col("far").alias("far_y")), "b").where("far_x + far_y >= gap AND (x <> a OR y <> b)")
    return verified(both.select(F.col("x").alias("a"), F.col("y").alias("b")), sets, percent)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of ``edges`` (a, b) reaches. Large-star, small-star, until stable."""
    spark = edges.sparkSession
    state = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20, 0)")).alias("h")).first()
        if (now["n"], now["h"]) == seen:
            return state.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
        seen = (now["n"], now["h"])
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        before, state = state, save(small, "edges")
        let_go(spark, before)


# ------------------------------------------------------------------------------------------------------- operators


def link_classes(docs: DataFrame, shingle: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of ``docs``."""
    spark = docs.sparkSession
    sets = shingle_sets(docs, key, text, shingle, percent)
    firsts = sets.where("first").select("block", "cls", "doc_id")  # a class is one row a block
    classes = firsts.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    kept = ("doc_id", "grp", "n", "tokens", "places", "often", "sketch")
    leads = sets.where("lead").select("cls", *kept)
    own = save(leads.join(classes, (leads["cls"] == classes["cls"]) & (leads["doc_id"] == classes["rep"]), "left_semi").select(*kept), "leads")
    groups = own.groupBy("grp").agg(F.min("doc_id").alias("id"))
    heads = own.join(groups, (own["grp"] == groups["grp"]) & (own["doc_id"] == groups["id"]), "left_semi").select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("comp"), "n", "tokens", "places")
    weight = F.size("tokens") + BITS // 256 * F.size(F.filter("often", lambda x: x))  # a sketch weighs as much as so many entries
    parts = parts_for(int(own.agg(F.sum(weight)).first()[0] or 0), POSTINGS)
    hot = hot_postings(own)
    met = _in_ranges(heads, parts, leaders(percent), "a long, b long, shared long", hot, tiles=False).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    best = met.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    inside = own.select(F.col("doc_id").alias("a"), "grp").join(groups, "grp").where("a <> id").select("a", F.col("id").alias("b"))
    close = save(measured(best.unionByName(inside), sets), "measured")
    first = close.where(linked(percent)).select("a", "b")
    away = close.join(inside.distinct(), ["a", "b"], "left_semi").groupBy(F.col("a").alias("doc_id")).agg(F.max(F.col("n") + F.col("m") - 2 * F.col("common")).alias("away"))
    far = save(own.join(away, "doc_id", "left").withColumn("away", F.coalesce("away", F.lit(0).cast("long"))), "leads")
    let_go(spark, own)

    links, nearest, passes = first, True, 0
    while True:
        nodes = save(components(links), "components")
        placed = far.join(nodes, far["doc_id"] == nodes["node"], "left").select(*kept, "away", F.coalesce("comp", "doc_id").alias("comp"))
        # one entry for each group and component; its members are met only where its head meets another component's
        slack = F.when(F.count("*") > 1, F.max("away") + F.min_by("away", "doc_id")).otherwise(0).cast("long")
        placed = placed.join(placed.groupBy("grp", "comp").agg(F.min("doc_id").alias("id"), slack.alias("slack")), ["grp", "comp"])
        heads = placed.where("doc_id = id").select("id", "comp", "n", "slack", "tokens", "places", "often", "sketch")
        met = _in_ranges(heads, parts, crossing(percent, nearest), "a long, b long, whole boolean", hot, tiles=True)
        pairs = save(met.groupBy("a", "b").agg(F.min("whole").alias("whole")), "pairs")
        second = save(verified(pairs.select("a", "b"), sets, percent), "links")
        if not nearest or not pairs.where("NOT whole").head(1):
            break
        passes, links = passes + 1, links.unionByName(second)
        nearest = passes < PASSES and bool(second.head(1))
        let_go(spark, nodes, pairs)
    pairs = pairs.select("a", "b")
    third = save(between_members(pairs, placed.where("doc_id <> id").select("id", "doc_id"), sets, percent), "links")
    # an id that several classes have is one document
    several = sets.where("n > 0").groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("doc_id")
    held = sets.where("n > 0").select("doc_id", "cls").join(several, "doc_id").distinct().join(classes, "cls").select("doc_id", "rep").distinct()
    least = held.groupBy("doc_id").agg(F.min("rep").alias("low"))
    same_id = held.join(least, "doc_id").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    everything = links.unionByName(second).unionByName(third).unionByName(same_id)
    final = save(components(everything), "components")
    let_go(spark, pairs, far, nodes, close)

    of_class = classes.join(final, classes["rep"] == final["node"], "left").select("cls", F.coalesce("comp", "rep").alias("component_id"))
    of_block = firsts.select("block", "cls").join(of_class, "cls")
    placed = sets.select("block", "doc_id", "n", "cls").join(of_block, ["block", "cls"], "left")
    known = lambda c: F.when(c != LEAST_ID, c)
    return placed.select(known(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("component_id", "doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document for each component, all columns: that of the smallest id; of its rows with the same words, one.

    Rows without an id are documents of their own, known by their words, and come before all ids.
    """
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase)
    words = F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "))
    ident = F.coalesce(F.col(key).cast("long"), F.lit(LEAST_ID) + F.xxhash64(words).bitwiseAND(F.lit((1 << 62) - 1)))
    rows = docs.withColumn("__id", ident)
    found = save(link_classes(rows, shingle, percent, "__id", text), "classes")
    states = found.groupBy(F.col("doc_id").alias("__id")).agg((F.min("component_id") == F.col("doc_id")).alias("__stays"), F.count("*").alias("__n"))
    kept = rows.join(states.where("NOT __stays OR __n > 1"), "__id", "left").where("coalesce(__stays, true)")
    repeated = kept.where("__n > 1").withColumn("__rank", F.row_number().over(Window.partitionBy("__id", words).orderBy(F.to_json(F.struct(*docs.columns)))))
    return kept.where("__n IS NULL").select(*docs.columns).unionByName(repeated.where("__rank = 1").select(*docs.columns))
