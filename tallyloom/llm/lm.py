"""Language-model scoring with a weighted backoff automaton.

States are n-gram contexts that occur in the training texts; the root is the empty context. An arc (state, word) has
the smoothed probability of the word after that context and leads to the longest known context that ends in the word; a
failure arc has the state's backoff weight and leads to the context without its first word. One traversal of a text from
left to right carries the state and adds the logarithms of the arcs it takes.

Smoothing is hierarchical: p(w | h) = (c(h w) + mass * p(w | h')) / (c(h) + mass), with (c(w) + 1) / (N + V + 1) at the
root, V distinct words, N training tokens; so seen continuations are arcs and mass / (c(h) + mass) is the failure weight.
Each context's probabilities sum to one. No n-gram is pruned: counts of all n-grams of all training texts are taken, and
a block of documents gets the part of the automaton that its texts can reach: states, arcs in one sorted table, failure
arcs. Hashes stand for n-grams.

Defined results: null and empty texts are the end token alone; a text's end is a token; repeated rows are scored and
counted each; extra columns are ignored; an empty table gives an empty table; with no training text every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tallyloom.llm.common import COUNT_SCHEMA, Tokens, count_rows, each_block, held_out, mix, pack_blocks, parts_for, save, texts_of, told_totals, totals, with_answers

#: n-grams in a hash range of the counting step; tokens of a text that one walk takes.
GRAMS, PIECE = 2_000_000, 256
#: Hashes of n-grams of two words and more have as many bits as the corpus has n-grams, and so many more (64 at most):
#: the chance that an n-gram shares its hash with another is 2 ** -APART at every size.
APART = 24
_END = np.uint64(0x5BD1E9955BD1E995)


class Order:
    """The distinct n-grams of one order in a block.

    ``hashes`` ascend; ``counts`` are the block's own training counts; ``index`` has each position's n-gram (-1 where the
    text starts too near). Of each n-gram: its last word, the n-gram without its last and the one without its first word.
    """

    def __init__(self, hashes: np.ndarray, valid: np.ndarray, size: int, train: np.ndarray, below: Order | None, words: np.ndarray | None) -> None:
        self.hashes, inverse = np.unique(hashes[valid], return_inverse=True)
        self.counts = np.bincount(inverse, weights=train[valid], minlength=len(self.hashes)).astype(np.int64)
        self.index = np.full(size, -1)
        self.index[valid] = inverse
        some = np.empty(len(self.hashes), np.int64)  # a position of each
        some[inverse] = valid
        self.word = self.index[some] if words is None else words[some]
        self.prefix = self.suffix = None
        if below is not None:
            self.prefix, self.suffix = below.index[some - 1], below.index[some]


class Grams:
    """Tokens of a block (each text's words, then its end) with all n-grams up to ``order``.

    bits: of the hashes of n-grams of two words and more; those of single words keep all 64.
    """

    def __init__(self, table: pa.Table, text: str, order: int, bits: int = 64) -> None:
        tokens = Tokens(texts_of(table, text, lower=True))
        sizes = tokens.ends - tokens.starts + 1
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.n = n = int(self.ends[-1]) if len(sizes) else 0
        is_end = np.zeros(n, bool)
        is_end[self.ends - 1] = True
        at = np.arange(n) - np.repeat(self.starts, sizes)
        train = np.repeat(~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool), sizes)
        word = np.empty(n, np.uint64)
        word[~is_end], word[is_end] = mix(tokens.hashes())[tokens.ids], _END
        whole, self.orders = mix(word + np.uint64(1)), []
        for k in range(1, order + 1):
            if k > 1 and n:
                whole = mix(np.r_[np.zeros(1, np.uint64), whole[:-1]] * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k))
            short = whole if k == 1 else whole >> np.uint64(64 - bits)
            self.orders.append(Order(short, np.flatnonzero(at >= k - 1), n, train, self.orders[-1] if k > 1 else None, self.orders[0].index if k > 1 else None))


class Automaton:
    """The states and arcs that a block of texts can reach.

    totals: training counts over the whole corpus of each order's n-grams. State 0 is the root, the empty context.
    """

    def __init__(self, orders: list[Order], totals: list[np.ndarray], tokens: int, types: int, mass: float) -> None:
        self.words = max(1, len(totals[0]))
        self.root = (totals[0] + 1.0) / (tokens + types + 1.0)
        self.unknown = -np.log10(tokens + types + 1.0)
        keys, logs, targets = [], [], []
        fail, fail_log, size = [np.zeros(1, np.int64)], [np.zeros(1)], 1
        lower, below = self.root, None  # smoothed probabilities and states of the n-grams one word shorter
        for k, (own, count) in enumerate(zip(orders, totals, strict=True), start=1):
            seen = np.flatnonzero(count > 0)  # so are their prefixes and suffixes
            p, states = np.zeros(len(count)), np.zeros(len(count), np.int64)
            if k == 1:
                p, source, shorter = self.root, np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
            else:
                p[seen] = (count[seen] + mass * lower[own.suffix[seen]]) / (totals[k - 2][own.prefix[seen]] + mass)
                source, shorter = below[own.prefix[seen]], below[own.suffix[seen]]
            if k < len(orders):  # contexts are states
                states[seen] = size + np.arange(len(seen))
                size += len(seen)
                fail.append(shorter)
                fail_log.append(np.log10(mass / (count[seen] + mass)))
                targets.append(states[seen])
            else:
                targets.append(shorter)
            keys.append(source * self.words + own.word[seen])
            logs.append(np.log10(p[seen]))
            lower, below = p, states
        key = np.concatenate(keys)
        order = np.argsort(key)
        self.keys, self.logs, self.targets = key[order], np.concatenate(logs)[order], np.concatenate(targets)[order]
        self.fail, self.fail_log, self.memory = np.concatenate(fail), np.concatenate(fail_log), len(orders) - 1

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, next state) of one word after each state: failure arcs are taken until an arc fits."""
        state, log, target, still = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(still):
            key = state[still] * self.words + word[still]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            fits = self.keys[arc] == key if len(self.keys) else np.zeros(len(still), bool)
            at, arc = still[fits], arc[fits]
            log[at] += self.logs[arc]
            target[at] = self.targets[arc]
            still = still[~fits]
            lost = state[still] == 0
            log[still[lost]] += self.unknown  # an unknown word leads from the root to the root
            still = still[~lost]
            log[still] += self.fail_log[state[still]]
            state[still] = self.fail[state[still]]
        return log, target

    def traverse(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 of every token's probability, by one walk through each text from left to right.

        All texts walk abreast, each with its own state. A long text is cut into pieces that walk abreast too: a state
        is fixed by the last ``memory`` words, so a piece that starts so many words earlier arrives in the right one.
        """
        pieces = -(-(ends - starts) // PIECE)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(starts, pieces) + nth * PIECE
        stop = np.minimum(first + PIECE, np.repeat(ends, pieces))
        begin = np.maximum(first - self.memory, np.repeat(starts, pieces))
        order = np.argsort(begin - stop, kind="stable")  # the longest first
        begin, first, stop = begin[order], first[order], stop[order]
        out, state = np.zeros(len(words)), np.zeros(len(begin), np.int64)
        for step in range(int((stop - begin).max(initial=0))):
            walking = int(np.searchsorted(begin - stop, -step, side="left"))
            at = begin[:walking] + step
            log, state = self.step(state[:walking], words[at])
            new = at >= first[:walking]
            out[at[new]] = log[new]
        return out


def score(docs: DataFrame, is_held_out: Column, order: int = 2, mass: float = 200.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score); learns from rows that are not held out."""
    rows = docs.select(F.col(key), F.col(text), is_held_out.alias("held_out"))
    blocks = pack_blocks(rows, text)
    size = int(rows.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    parts, bits = parts_for(size // 8, GRAMS), min(64, max(1, size // 6).bit_length() + APART)
    ranges = [range(k * parts, (k + 1) * parts) for k in range(order)]

    def count(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        for k, own in enumerate(Grams(table, text, order, bits).orders):
            yield from count_rows(block, own.hashes, own.counts, parts, ranges[k].start, bits if k else 64)

    answers = save(totals(each_block(blocks, count, COUNT_SCHEMA), parts * order), "grams")
    words = answers.where(F.col("part") < parts).agg(F.sum("entries").alias("n"), F.sum("distinct").alias("v")).first()
    n_train, types = words["n"] or 0, words["v"] or 0

    def finish(block: int, table: pa.Table, answer: pa.Table) -> pa.Table:
        grams = Grams(table, text, order, bits)
        counts = [told_totals(answer, own.hashes, r) for own, r in zip(grams.orders, ranges, strict=True)]
        automaton, words = Automaton(grams.orders, counts, n_train, types, mass), grams.orders[0].index

        def by_text(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, grams.starts) if len(x) else x

        return pa.table(
            {
                key: table.column(key), "held_out": table.column("held_out"), "n_tokens": pa.array(grams.ends - grams.starts), "n_known": pa.array(by_text((counts[0][words] > 0).astype(np.int64))),
                "train_tokens": pa.array([n_train] * table.num_rows, pa.int64()), "base_score": pa.array(by_text(np.log10(automaton.root[words]))), "score": pa.array(by_text(automaton.traverse(words, grams.starts, grams.ends))),
            }
        )

    fields = [("held_out", BooleanType()), ("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()), ("base_score", DoubleType()), ("score", DoubleType())]
    return with_answers(blocks, answers, finish, StructType([docs.schema[key], *(StructField(n, t) for n, t in fields)]))


def default_held_out(key: str = "doc_id") -> Column:
    return held_out(F.col(key), 7)
