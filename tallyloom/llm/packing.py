"""Sequence packing as a cutting-stock problem solved by column generation.

1. Texts are encoded once and written (id bytes). Whole sequences are cut from long documents; what remains of a
   document has a length below the sequence length.
2. The remainders' length histogram (classes of ``GRAIN`` tokens, so at most length / GRAIN rows) goes to the driver.
   A linear program over patterns (how many remainders of each class share a sequence) is solved by column generation:
   a knapsack dynamic program prices new patterns with the current duals until none saves anything.
3. Every block of encoded documents is packed where it lies, without a shuffle: the program's solution is scaled to the
   block and rounded down, patterns take the ranked documents of their classes, and patterns are used again while they
   fit. What is over - rounding leftovers, and the few tokens by which class lengths understate real ones - is cut
   freely to fill the remaining room, and the very last tokens of a block make sequences of powers of two.

Defined results: a null or empty text is the end id alone; repeated rows (also of one id) are packed each for itself;
an empty table gives no pieces; extra columns are ignored. Blocks hold ``BLOCK_TOKENS``, so memory is bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.llm import bpe
from tallyloom.llm.common import save, trimmed

GRAIN = 16
BLOCK_TOKENS = 2_000_000
#: Column generation ends at the optimum (a few hundred columns); after so many it has gone astray and is an error.
MOST_COLUMNS = 100_000

Patterns = list[tuple[float, dict[int, int]]]


def best_pattern(worth: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the worthiest multiset of classes within ``room``, by dynamic programming over capacities."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = sizes <= c
        best[c], choice[c] = best[c - 1], -1
        if fits.any():
            gains = np.where(fits, worth + best[np.maximum(c - sizes, 0)], -1.0)
            k = int(gains.argmax())
            if gains[k] > best[c] + 1e-12:
                best[c], choice[c] = gains[k], k
    counts, c = np.zeros(len(sizes)), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return best[room], counts


def solve(demand: dict[int, int], room: int) -> Patterns:
    """Fractional pattern counts that meet ``demand`` (class size -> count) with the fewest sequences of ``room``."""
    sizes = np.array(sorted(k for k, v in demand.items() if 0 < k <= room and v > 0), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    for generated in count():
        if generated == MOST_COLUMNS:
            raise ArithmeticError(f"no optimum after {MOST_COLUMNS} columns")
        value, column = best_pattern(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-6:
            break
        level, step = inverse @ need, inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(level, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    level = inverse @ need
    return [(float(x), {int(s): int(n) for s, n in zip(sizes, columns[:, j], strict=True) if n}) for j, x in enumerate(level) if x > 1e-9]


def pack_lengths(lengths: list[int], patterns: Patterns, share: float, room: int, grain: int = GRAIN) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block; every token lies in exactly one piece.

    share: the block's part of the histogram that ``patterns`` were solved for.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    sequences, ranked, loose = 0, {}, []
    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        whole, rest = divmod(lengths[d], room)
        for k in range(whole):
            pieces.append((d, k * room, room, sequences, 0))
            sequences += 1
        if rest >= grain:
            ranked.setdefault(rest // grain, []).append((d, whole * room, rest))
        elif rest:
            loose.append((d, whole * room, rest))
    for queue in ranked.values():
        queue.reverse()
    open_room: list[tuple[int, int, int, int]] = []  # fill, sequence, and where its pieces stand

    def use(pattern: dict[int, int], times: int) -> None:
        nonlocal sequences
        for _ in range(times):
            at, begin = 0, len(pieces)
            for size, count in sorted(pattern.items(), reverse=True):
                for _ in range(count):
                    d, start, length = ranked[size].pop()
                    fits = min(length, room - at)
                    if fits:
                        pieces.append((d, start, fits, sequences, at))
                    at += fits
                    if length > fits:
                        loose.append((d, start + fits, length - fits))
            if at < room:
                open_room.append((at, sequences, begin, len(pieces)))
            sequences += 1

    def most(pattern: dict[int, int]) -> int:
        return min(len(ranked.get(size, ())) // count for size, count in pattern.items())

    order = sorted(patterns, key=lambda p: -p[0])
    for level, pattern in order:
        use(pattern, min(most(pattern), int(level * share)))
    for _, pattern in order:
        use(pattern, most(pattern))
    for size in sorted(ranked, reverse=True):
        loose += ranked[size][::-1]

    # sequences that stay open are filled by loose pieces; while those don't suffice, the emptiest is taken apart
    left, gaps = sum(x[2] for x in loose), sum(room - x[0] for x in open_room)
    open_room.sort(reverse=True)
    apart: set[int] = set()
    while open_room and left < gaps:
        at, _, begin, end = open_room.pop()
        left, gaps = left + at, gaps - (room - at)
        loose += [p[:3] for p in pieces[begin:end]]
        apart.update(range(begin, end))
    pieces = [p for i, p in enumerate(pieces) if i not in apart] if apart else pieces
    targets = [(seq, at, room) for at, seq, _, _ in open_room]
    extra = left - gaps
    while extra >= room:
        targets.append((sequences, 0, room))
        sequences, extra = sequences + 1, extra - room
    for bit in reversed(range(room.bit_length())):
        if extra >> bit & 1:
            targets.append((sequences, 0, 1 << bit))
            sequences += 1
    at_target, at = 0, targets[0][1] if targets else 0
    for d, start, length in loose:
        while length:
            seq, _, end = targets[at_target]
            fits = min(length, end - at)
            pieces.append((d, start, fits, seq, at))
            start, length, at = start + fits, length - fits, at + fits
            if at == end:
                at_target += 1
                at = targets[at_target][1] if at_target < len(targets) else 0
    return pieces


def pack(docs: DataFrame, path: str, length: int = 4096, end: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids binary): the pieces of all documents.

    ``ids`` (on demand) has the piece's token ids as little-endian unsigned 32-bit numbers. Sequences are full, or padded by the
    reader to ``length``, or hold exactly a power of two of tokens and need no padding.
    """
    coded = save(bpe.encoded_bytes(docs, path, end, key, text), "coded")
    rest = (F.col("n_tokens") % length / GRAIN).cast("int")
    demand = {r["size"]: r["n"] for r in coded.groupBy(rest.alias("size")).agg(F.count("*").alias("n")).collect()}
    width = bpe.id_type(path)
    patterns, classed = solve(demand, length // GRAIN), sum(v for k, v in demand.items() if k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held
            keys = pa.concat_arrays([b.column(0) for b in held])
            counts = [n for b in held for n in b.column(1).to_pylist()]
            ids = [np.frombuffer(x.as_buffer(), width) for b in held for x in b.column(2)]
            share = sum(1 for n in counts if n % length >= GRAIN) / max(1, classed)
            pieces = pack_lengths(counts, patterns, share, length)
            for i in range(0, len(pieces), 4096):
                d, start, size, seq, at = zip(*pieces[i : i + 4096], strict=True)
                cut = [ids[k][s : s + n].astype("<u4").tobytes() for k, s, n in zip(d, start, size, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(d, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, [zlib.crc32(x) for x in cut], [counts[k] for k in d], [next_id + s for s in seq], at)), *([pa.array(cut, pa.binary())] if with_ids else [])], names=out.names)
            next_id += max((p[3] for p in pieces), default=-1) + 1
            held = []

        tokens = 0
        for batch in batches:
            sizes = np.cumsum(batch.column(1).to_numpy())
            start = 0
            while start < batch.num_rows:
                done = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, done + BLOCK_TOKENS - tokens, side="right")))
                held.append(batch.slice(start, stop - start))
                tokens += int(sizes[stop - 1] - done)
                start = stop
                if tokens >= BLOCK_TOKENS or start < batch.num_rows:
                    yield from close()
                    tokens = 0
        if held:
            yield from close()

    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = StructType([coded.schema[key], *(StructField(n, LongType()) for n in names), *([coded.schema["ids"]] if with_ids else [])])
    return coded.mapInArrow(trimmed(run), out)
