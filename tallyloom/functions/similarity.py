"""String similarity kernels in plain Python and vectorised UDFs over them.

The kernels are importable without Spark. Scores are asked for distinct pairs only (see ``scored_pairs``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common part over both lengths."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of the longer one, cut windows at its edges included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best, signs = len(a), 0.0, set(a)
    for end in range(1, len(b) + n):
        start = max(0, end - n)
        stop = min(end, len(b))
        if b[stop - 1] in signs or b[start] in signs:
            best = max(best, ratio(a, b[start:stop]))
            if best == 100.0:
                break
    return best


def _tokens(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(s)) for s in (x & y, x - y, y - x))


def token_ratio(a: str, b: str) -> float:
    """The better of sorted words and of shared words with either rest."""
    both, left, right = _tokens(a, b)
    if both and not (left and right):
        return 100.0
    best = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    x, y = (both + " " + left).strip(), (both + " " + right).strip()
    best = max(best, ratio(x, y))
    return max(best, ratio(both, x), ratio(both, y)) if both else best


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _tokens(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(left, right))


@lru_cache(maxsize=100_000)
def weighted_ratio(a: str, b: str) -> float:
    """0 to 100: plain, word and partial ratios, weighted by how much the lengths differ; 0 if a text is empty."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    if lengths < 1.5:
        return max(ratio(a, b), 0.95 * token_ratio(a, b))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


#: Texts of this length and more ignore their frequent characters at first, as the ratio's definition asks.
FREQUENT_FROM = 200
#: Cells of one sheet of the kernel below; pairs are taken in lots that fill it.
SHEET = 1 << 20


def _codes(texts: list[str], width: int, filler: int) -> np.ndarray:
    """One row of code points a text, padded."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), width), filler, np.int64)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _frequent(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of characters that make up more than a hundredth (and one) of a long text."""
    rows, width = codes.shape
    key = (np.arange(rows)[:, None] << 22) | (codes & 0x3FFFFF)
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return (count[back].reshape(rows, width) > (sizes // 100 + 1)[:, None]) & (sizes >= FREQUENT_FROM)[:, None] & (np.arange(width) < sizes[:, None])


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair, of all pairs abreast.

    A segment is a part of one pair. Each round takes the segments of the greatest size class, finds the longest common run
    of each (the first in ``a``, then in ``b``), one row of all their tables at a time, and leaves the parts before and after
    it as further segments.
    """
    m, n = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    x, y = _codes(a, int(m.max(initial=0)) + 1, -1), _codes(b, int(n.max(initial=0)) + 1, -2)
    usable, total = ~_frequent(y, n), np.zeros(len(a), np.int64)
    waiting = np.stack([np.arange(len(a)), np.zeros_like(m), m, np.zeros_like(n), n])
    while True:
        waiting = waiting[:, (waiting[1] < waiting[2]) & (waiting[3] < waiting[4])]
        if not waiting.shape[1]:
            return total
        size_class = np.frexp(np.maximum(waiting[2] - waiting[1], waiting[4] - waiting[3]).astype(float))[1]
        now = size_class == size_class.max()
        (row, a0, a1, b0, b1), waiting = waiting[:, now], waiting[:, ~now]
        width = int((b1 - b0).max())
        at = b0[:, None] + np.arange(width)
        inside = at < b1[:, None]
        window = np.where(inside & usable[row[:, None], np.minimum(at, y.shape[1] - 1)], y[row[:, None], np.minimum(at, y.shape[1] - 1)], -3)
        run, size, i, j = np.zeros((len(row), width + 1), np.int32), np.zeros(len(row), np.int64), a0.copy(), b0.copy()
        for k in range(int((a1 - a0).max())):
            place = a0 + k
            here = np.where(place < a1, x[row, np.minimum(place, x.shape[1] - 1)], -4)
            run[:, 1:] = np.where(window == here[:, None], run[:, :-1] + 1, 0)
            end = run[:, 1:].argmax(1)
            best = run[np.arange(len(row)), end + 1]
            better = best > size
            size = np.where(better, best, size)
            i, j = np.where(better, place - best + 1, i), np.where(better, b0 + end - best + 1, j)
        while True:  # frequent characters next to a run belong to it
            more = (i > a0) & (j > b0) & (x[row, np.maximum(i - 1, 0)] == y[row, np.maximum(j - 1, 0)])
            if not more.any():
                break
            i, j, size = i - more, j - more, size + more
        while True:
            more = (i + size < a1) & (j + size < b1) & (x[row, np.minimum(i + size, x.shape[1] - 1)] == y[row, np.minimum(j + size, y.shape[1] - 1)])
            if not more.any():
                break
            size = size + more
        np.add.at(total, row, size)
        hit = size > 0
        before, after = np.stack([row, a0, i, b0, j])[:, hit], np.stack([row, i + size, a1, j + size, b1])[:, hit]
        waiting = np.concatenate([waiting, before, after], axis=1)


def sequence_ratios(a: Iterable[str | None], b: Iterable[str | None]) -> list[float]:
    """Matching-blocks ratio of lower-cased, stripped texts, three decimals; not symmetric; null gives 0, two empty texts 1."""
    pairs = [(None, None) if x is None or y is None else (x.lower().strip(), y.lower().strip()) for x, y in zip(a, b, strict=True)]
    out, known = [0.0] * len(pairs), sorted((k for k, (x, _) in enumerate(pairs) if x is not None), key=lambda k: len(pairs[k][0]) + len(pairs[k][1]))
    while known:
        lot, wide = [], 1
        while known and (not lot or (len(lot) + 1) * max(wide, *map(len, pairs[known[-1]])) <= SHEET):
            wide = max(wide, *map(len, pairs[known[-1]]))
            lot.append(known.pop())
        for k, found in zip(lot, _matched([pairs[k][0] for k in lot], [pairs[k][1] for k in lot]).tolist(), strict=True):
            both = len(pairs[k][0]) + len(pairs[k][1])
            out[k] = round(2.0 * found / both, 3) if both else 1.0
    return out


def sequence_ratio(a: str | None, b: str | None) -> float:
    return sequence_ratios([a], [b])[0]


@F.pandas_udf(DoubleType())
def weighted_ratio_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([weighted_ratio(x or "", y or "") / 100.0 for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def sequence_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(sequence_ratios(a, b), dtype=float)


def letter_facts(text: Column) -> Column:
    """Length, words, length of the distinct words, and every letter with its number among its likes: what
    ``weighted_bound`` needs of a text."""
    signs, words = F.array_sort(F.split(text, "")), F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    numbered = F.transform(signs, lambda c, i: F.concat(c, (i - F.array_position(signs, c)).cast("string")))
    return F.struct(F.length(text).alias("n"), words.alias("words"), F.length(F.array_join(words, " ")).alias("m"), numbered.alias("letters"))


def weighted_bound(a: Column, b: Column) -> Column:
    """The weighted ratio (0 to 1) of two texts is at most this, by their ``letter_facts``.

    A common word: 1. Else no part of the score finds more letters in common than both texts have, ``c``: a ratio of
    lengths n and m is at most 2c / (n + m), and one against a window, which may be cut, at most 2c / (shorter + c).
    """
    c, least = F.size(F.array_intersect(a["letters"], b["letters"])), F.least(a["m"], b["m"])
    plain, words = 2 * c / (a["n"] + b["n"]), 2 * c / (a["m"] + b["m"])
    close = F.greatest(a["n"], b["n"]) < 1.5 * F.least(a["n"], b["n"])
    bound = F.when(close, F.greatest(plain, 0.95 * words)).otherwise(F.greatest(plain, 0.9 * 2 * c / (least + c)))
    return F.when(F.arrays_overlap(a["words"], b["words"]) | (least == 0) | (c == 0) & (least + c == 0), F.lit(1.0)).otherwise(bound)


def edit_similarity(a, b):
    """1 - edit distance over the longer length, in the JVM."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def scored_pairs(pairs: DataFrame, left: str, right: str, scorer: str = "weighted") -> DataFrame:
    """``pairs`` with ``score``; each distinct pair of texts is scored once."""
    if scorer == "edit":
        return pairs.withColumn("score", edit_similarity(F.col(left), F.col(right)))
    udf = weighted_ratio_udf if scorer == "weighted" else sequence_ratio_udf
    scores = pairs.select(left, right).distinct().withColumn("score", udf(F.col(left), F.col(right)))
    return pairs.join(scores, [left, right])
