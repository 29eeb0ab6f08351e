"""Exact substring deduplication by level-wise doubling.

A word goes if a window of ``window`` words around it also starts earlier: in a document of smaller id, or earlier in
the same one. Level one looks at windows of half that length. Of the half windows inside a full window, the one of
least hash stands for it (the leftmost of equals): equal full windows have equal stand-ins at equal places, so a full
window whose stand-in is alone in the corpus cannot repeat and is done. Consecutive full windows with one stand-in are
one candidate, a run. Only runs whose half window is repeated are extended to full length at level two:

* runs that are equal as a whole go together - all but the earliest are repeats, window by window;
* where one half window has several different runs, their earliest ones are compared window by window.

Blocks of documents send, for each distinct run or window, their earliest occurrence to its own hash range and get back
which of them start earlier elsewhere; for each distinct half window they send one row that tells its run, or that it has
several, and get back which have several. So nothing meets in one place more than once a block: of a passage that a third
of all documents share, the runs at its edges differ from document to document and part by their own hashes. 64-bit
hashes of word runs stand for their words.

Defined results: null and empty texts have no words and nothing removed; texts below ``window`` words are untouched;
a null id counts as the smallest, and ids must be integers; rows that repeat an id are one document, so where both start
at one place neither is earlier; other columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.llm.common import BLOB_SCHEMA, RunHashes, Tokens, blob_rows, blobs_by_part, blobs_of, by_block, each_block, gather_parts, joined, mix, pack_blocks, parts_for, save, texts_of, with_answers

#: Runs in a hash range, at most about so many in a task.
RUNS = 1_500_000
EARLIER, SEVERAL, WINDOWS = 0, 1, 2
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def least_of(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost minimum of values[i : i + span], for every i, by doubling the span."""
    best, width = np.arange(len(values)), 1
    while 2 * width <= span:
        left, right = best[:-width], best[width:]
        best = np.where(values[right] < values[left], right, left)
        width *= 2
    if width < span:
        left, right = best[: len(best) - (span - width)], best[span - width :]
        best = np.where(values[right] < values[left], right, left)
    return best


def earliest(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): entries sorted by key, document, place; first[i] is the index of the first entry of i's key."""
    order = np.lexsort((at, doc, key))
    new = np.r_[True, np.diff(key[order]) != 0] if len(order) else np.empty(0, bool)
    lead = order[np.flatnonzero(new)]
    first = np.empty(len(order), np.int64)
    first[order] = lead[np.cumsum(new) - 1]
    return order, first


class Block:
    """Words of a block's documents with their candidate runs."""

    def __init__(self, table: pa.Table, key: str, text: str, window: int) -> None:
        self.window = window
        self.raw = texts_of(table, text, lower=False)
        self.tokens = tokens = Tokens(self.raw)
        self.doc_id = table.column(key).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()
        words = tokens.hashes()[tokens.ids]
        hashes = RunHashes(words)
        n, half = tokens.n, window // 2
        doc = np.repeat(np.arange(len(self.raw)), tokens.ends - tokens.starts)
        if n < window:
            self.first = self.last = self.run_doc = self.run_at = np.empty(0, np.int64)
            self.half = self.whole = np.empty(0, np.uint64)
            return
        stand_in = least_of(short := hashes.windows(half), window - half + 1)
        start = np.flatnonzero(np.arange(n - window + 1) + window <= tokens.ends[doc[: n - window + 1]])
        lead = stand_in[start]
        new = np.r_[True, (np.diff(lead) != 0) | (np.diff(start) != 1)] if len(start) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        self.first = start[begin]
        self.last = start[np.r_[begin[1:] - 1, len(start) - 1]] if len(start) else begin
        lead = lead[begin]
        self.half = short[lead]
        place = ((lead - self.first) * 4096 + self.last - self.first).astype(np.uint64)
        self.whole = mix(hashes.runs(self.first, self.last + window) + place * np.uint64(0x9E3779B97F4A7C15))
        self.full = hashes.windows(window)
        self.doc = doc
        self.run_doc, self.run_at = self.doc_id[doc[self.first]], self.first - tokens.starts[doc[self.first]]
        order, self.run_first = earliest(self.whole, self.run_doc, self.run_at)
        self.same_place = (self.run_doc == self.run_doc[self.run_first]) & (self.run_at == self.run_at[self.run_first])

    def leaders(self) -> np.ndarray:
        """One run for each distinct one: the block's earliest."""
        return np.unique(self.run_first) if len(self.first) else self.first

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct half windows, the run that each stands in; 0 where it has several)."""
        lead = self.leaders()
        half, first, count = np.unique(self.half[lead], return_index=True, return_counts=True)
        return half, np.where(count == 1, self.whole[lead][first], np.uint64(0))

    def compared(self, earlier: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, window hash, document, place, first) of the windows of the earliest runs whose half window has several."""
        runs = np.flatnonzero(np.isin(self.half, several) & self.same_place & ~np.isin(self.whole, earlier)) if len(self.first) else self.first
        sizes = self.last[runs] - self.first[runs] + 1
        start = np.repeat(self.first[runs], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if not len(start):
            return start, np.empty(0, np.uint64), start, start, start
        code, doc = self.full[start], self.doc_id[self.doc[start]]
        at = start - self.tokens.starts[self.doc[start]]
        return start, code, doc, at, earliest(code, doc, at)[1]

    def removed(self, earlier: np.ndarray, several: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Of every word, whether a window around it starts earlier somewhere."""
        edge = np.zeros(self.tokens.n + 1, np.int64)
        if len(self.first):
            gone = np.isin(self.whole, earlier) | ~self.same_place
            np.add.at(edge, self.first[gone], 1)
            np.add.at(edge, self.last[gone] + self.window, -1)
            start, code, doc, at, first = self.compared(earlier, several)
            late = np.isin(code, windows) | (doc != doc[first]) | (at != at[first])
            np.add.at(edge, start[late], 1)
            np.add.at(edge, start[late] + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def level_one(found: dict[str, np.ndarray], block: np.ndarray) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """Of a hash range of runs, which have an equal earlier one; of a range of half windows, which have several runs."""
    if "half" in found:
        order = np.argsort(found["half"], kind="stable")
        half, whole, block = found["half"][order], found["whole"][order], block[order]
        starts = np.flatnonzero(np.r_[True, np.diff(half) != 0]) if len(half) else np.empty(0, np.int64)
        low, high = np.minimum.reduceat(whole, starts), np.maximum.reduceat(whole, starts)
        several = np.repeat((low != high) | (low == 0), np.diff(np.r_[starts, len(half)]))
        yield from by_block(block[several], SEVERAL, {"h": half[several]})
        return
    whole, doc, at = found["whole"], found["doc"], found["at"]
    _, first = earliest(whole, doc, at)
    late = (doc != doc[first]) | (at != at[first])
    yield from by_block(block[late], EARLIER, {"h": whole[late]})


def level_two(found: dict[str, np.ndarray], block: np.ndarray) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    code, doc, at = found["code"], found["doc"], found["at"]
    _, first = earliest(code, doc, at)
    late = (doc != doc[first]) | (at != at[first])
    yield from by_block(block[late], WINDOWS, {"h": code[late]})


def mark(docs: DataFrame, window: int, key: str, text: str, finish, schema) -> DataFrame:
    """``finish(table, Block, removed)`` for every block of documents, once all levels are through."""
    blocks = pack_blocks(docs, text)
    runs = parts_for(int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 36, RUNS)

    def send_runs(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        b = Block(table, key, text, window)
        lead = b.leaders()
        yield from blobs_by_part(block, 0, b.whole[lead], runs, {"whole": b.whole[lead], "doc": b.run_doc[lead], "at": b.run_at[lead].astype(np.int32)})
        half, whole = b.halves()
        yield from blobs_by_part(block, 0, half, runs, {"half": half, "whole": whole}, base=runs)

    first = save(gather_parts(each_block(blocks, send_runs, BLOB_SCHEMA), level_one, 2 * runs), "runs")

    def send_windows(block: int, table: pa.Table, answer: pa.Table) -> pa.Table:
        found = blobs_of(answer)
        several = joined(found, SEVERAL, "h", np.uint64)
        rows = []
        if len(several):
            _, code, doc, at, lead = Block(table, key, text, window).compared(joined(found, EARLIER, "h", np.uint64), several)
            lead = np.unique(lead)
            rows = list(blobs_by_part(block, 0, code[lead], runs, {"code": code[lead], "doc": doc[lead], "at": at[lead].astype(np.int32)}))
        return pa.Table.from_batches(rows or [blob_rows([])])

    second = gather_parts(with_answers(blocks, first, send_windows, BLOB_SCHEMA), level_two, runs)

    def end(block: int, table: pa.Table, answer: pa.Table) -> pa.Table:
        found = blobs_of(answer)
        b = Block(table, key, text, window)
        return finish(table, b, b.removed(*(joined(found, kind, "h", np.uint64) for kind in (EARLIER, SEVERAL, WINDOWS))))

    return with_answers(blocks, first.unionByName(second), end, schema)


def _each(b: Block, removed: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    gone = np.r_[0, np.cumsum(removed)]
    for i, (s, e) in enumerate(zip(b.tokens.starts.tolist(), b.tokens.ends.tolist(), strict=True)):
        yield i, s, e, int(gone[e] - gone[s])


def digests(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for every row."""

    def finish(table: pa.Table, b: Block, removed: np.ndarray) -> pa.Table:
        words, ids, keep, counts, gone, codes = b.tokens.vocab, b.tokens.ids, ~removed, [], [], []
        for _, s, e, r in _each(b, removed):
            counts.append(e - s)
            gone.append(r)
            codes.append(hashlib.sha256(b" ".join([words[w] for w in (ids[s:e][keep[s:e]] if r else ids[s:e]).tolist()])).hexdigest())
        return pa.table({key: table.column(key), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(codes, pa.string())})

    docs = docs.select(key, text)
    return mark(docs, window, key, text, finish, StructType([docs.schema[key], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]))


def deduplicate(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, ``text`` without the repeated words; what is kept stands as it stood, gaps become line ends."""

    def finish(table: pa.Table, b: Block, removed: np.ndarray) -> pa.Table:
        texts = table.column(text).to_pylist()
        for i, s, e, r in _each(b, removed):
            if r:
                spans = [m.span() for m in _WORD.finditer(b.raw[i])]
                keep = np.flatnonzero(~removed[s:e])
                runs = np.split(keep, np.flatnonzero(np.diff(keep) != 1) + 1) if len(keep) else []
                texts[i] = b"\n".join(b.raw[i][spans[x[0]][0] : spans[x[-1]][1]] for x in runs).decode()
        at = table.schema.get_field_index(text)
        return table.set_column(at, table.schema.field(at), pa.array(texts, table.schema.field(at).type))

    return mark(docs, window, key, text, finish, docs.schema)
