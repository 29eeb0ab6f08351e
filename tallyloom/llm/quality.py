"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text are computed in one pass. Small gradient-boosted trees are grown on labelled rows; every
path from a root to a node is a rule, a conjunction of at most ``DEPTH`` comparisons. A logistic model with lasso weights
over the rules keeps few of them, and what is kept is compiled into one Spark column expression.

Labels come from at most ``SAMPLE`` labelled rows, those of least id hash, and where documents repeat an id, from at most
twice as many rows of documents (the documented bounds of the fit); every row is scored. Held-out rows are never learned from. Defined results: null text counts as empty; empty texts get the score of
their (zero) statistics; a text of any length is read whole; without labels of both kinds the score is 0.5; label rows with null quality are not used;
repeated rows are scored each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyloom.llm.common import held_out, small_batches, trimmed

SAMPLE, TREES, DEPTH, BINS = 20_000, 30, 3, 32
STATISTICS = ("log_words", "mean_word", "upper", "digit", "symbol", "loud", "punct", "letter", "line_words", "distinct", "adjacent", "same_lines")
_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _LOUD, _PUNCT, _OTHER = range(8)


def _classes() -> np.ndarray:
    """Class of every code point of the basic plane; those beyond count as other."""
    table = np.full(1 << 16, _OTHER, np.uint8)
    kinds = {"Lu": _UPPER, "Lt": _UPPER, "Ll": _LOWER, "Lo": _LOWER, "Lm": _LOWER, "Nd": _DIGIT, "Zs": _SPACE}
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        table[c] = kinds.get(kind, _PUNCT if kind[0] in "PS" else _OTHER)
    table[[9, 10, 11, 12, 13, 32]] = _SPACE
    table[[ord(c) for c in "#*$%&|<>"]] = _SYMBOL
    table[[ord(c) for c in "!?"]] = _LOUD
    return table


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATISTICS for each text."""
    global _table
    if _table is None:
        _table = _classes()
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.bincount(_table[np.minimum(codes, 0xFFFF)], minlength=8)
        words, lines = text.split(), text.split("\n")
        letters, visible, count = n[_UPPER] + n[_LOWER], max(1, len(codes) - n[_SPACE]), max(1, len(words))
        out[i] = (
            np.log1p(len(words)), visible / count, n[_UPPER] / max(1, letters), n[_DIGIT] / visible, n[_SYMBOL] / visible, n[_LOUD] / visible, n[_PUNCT] / visible, letters / visible,
            np.log1p(count / len(lines)), len(set(words)) / count, sum(map(operator.eq, words, words[1:])) / count, 1 - len(set(lines)) / len(lines),
        )
    return out


_table: np.ndarray | None = None


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and ``stat_*`` of the text."""
    kept = [c for c in docs.columns if c != text]
    names = [f"stat_{s}" for s in STATISTICS]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = statistics(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *(pa.array(values[:, k]) for k in range(len(names)))], names=[*kept, *names])

    return docs.mapInArrow(trimmed(run), StructType([*(docs.schema[c] for c in kept), *(StructField(n, DoubleType()) for n in names)]))


# ------------------------------------------------------------------------------------------------- learning


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound): all must hold


def grow(x: np.ndarray, gradient: np.ndarray, borders: list[np.ndarray], binned: np.ndarray, rows: np.ndarray, path: Rule, found: list[tuple[Rule, float]], step: np.ndarray) -> None:
    """Split where the squared gradient sum gains most; every node's path becomes a rule."""
    mean = gradient[rows].mean()
    if path:
        found.append((path, mean))
    step[rows] = mean
    if len(path) == DEPTH or len(rows) < 40:
        return
    best = (1e-9, -1, 0)
    for k, cuts in enumerate(borders):
        if not len(cuts):
            continue
        sums = np.cumsum(np.bincount(binned[rows, k], weights=gradient[rows], minlength=len(cuts) + 1))[:-1]
        ns = np.cumsum(np.bincount(binned[rows, k], minlength=len(cuts) + 1))[:-1]
        fine = (ns >= 10) & (len(rows) - ns >= 10)
        total = gradient[rows].sum()
        gain = np.where(fine, sums**2 / np.maximum(ns, 1) + (total - sums) ** 2 / np.maximum(len(rows) - ns, 1), -np.inf) - total**2 / len(rows)
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = (gain[j], k, j)
    if best[1] < 0:
        return
    _, k, j = best
    above = binned[rows, k] > j
    for side in (False, True):
        grow(x, gradient, borders, binned, rows[above == side], (*path, (k, side, float(borders[k][j]))), found, step)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, k] > v) == above for k, above, v in rule])


def rules_of(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    borders = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(b, x[:, k], side="left") for k, b in enumerate(borders)], axis=1)
    draw, margin, found = np.random.default_rng(7), np.zeros(len(y)), []
    for _ in range(TREES):
        gradient, step = y - 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        rows = np.sort(draw.choice(len(y), size=max(1, len(y) // 2), replace=False)) if len(y) > 400 else np.arange(len(y))
        own: list[tuple[Rule, float]] = []
        grow(x, gradient, borders, binned, rows, (), own, step)
        for rule, value in own:
            if len(rule) == DEPTH or not any(len(o) > len(rule) and o[: len(rule)] == rule for o, _ in own):
                margin += 2.0 * value * holds(rule, x)
        found += own
    unique: dict[bytes, Rule] = {}
    for rule, _ in found:
        at = holds(rule, x)
        if 0 < at.sum() < len(at):
            unique.setdefault(np.packbits(at if at[0] else ~at).tobytes(), rule)
    return list(unique.values())


def lasso(z: np.ndarray, y: np.ndarray, strength: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty by accelerated proximal gradients; the intercept is free."""
    n, m = z.shape
    rate = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    w = v = np.zeros(m)
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        w_new = v - rate * (z.T @ error) / n
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * strength, 0)
        b_new, t_new = c - rate * error.mean(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]] | None:
    """(intercept, weighted rules), or nothing if there are not both kinds of labels."""
    if not len(y) or y.min() == y.max():
        return None
    check = np.arange(len(y)) % 5 == 0
    inner = rules_of(x[~check], y[~check])
    best = (np.inf, 0.001)
    z = np.stack([holds(r, x) for r in inner], axis=1).astype(float) if inner else np.zeros((len(y), 0))
    if z.shape[1] and len(set(y[~check])) == 2:
        for strength in (0.0003, 0.001, 0.003):
            b, w = lasso(z[~check], y[~check], strength, 150)
            p = np.clip(1 / (1 + np.exp(-(z[check] @ w + b))), 1e-6, 1 - 1e-6)
            best = min(best, (-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean(), strength))
    rules = rules_of(x, y)
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    b, w = lasso(np.stack([holds(r, x) for r in rules], axis=1).astype(float), y, best[1])
    return b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4]


def compiled(model: tuple[float, list[tuple[Rule, float]]] | None) -> Column:
    """The model as one column expression over ``stat_*``."""
    if model is None:
        return F.lit(0.5)
    margin = F.lit(model[0])
    for rule, weight in model[1]:
        tests = [F.col(f"stat_{STATISTICS[k]}") > v if above else F.col(f"stat_{STATISTICS[k]}") <= v for k, above, v in rule]
        margin = margin + F.when(reduce(operator.and_, tests), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-margin))


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, sample: int = SAMPLE, key: str = "doc_id", text: str = "text"):
    """Fit on labelled rows that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key), modulus)).select(F.col(key).alias("__id"), F.col("quality").cast("double").alias("__y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample))  # bounded by ``sample``
    rows = with_statistics(docs.select(key, text).join(chosen, F.col(key) == F.col("__id")).select("__id", "__y", text), text).orderBy(F.xxhash64("__id"), "__id", "__y").limit(2 * sample).toPandas()
    return fit(rows[[f"stat_{s}" for s in STATISTICS]].to_numpy(), rows["__y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for every row."""
    model = learn(docs, labels, modulus, key=key, text=text)
    scored = with_statistics(docs.select(key, text), text).withColumn("score", compiled(model))
    return scored.select(key, held_out(F.col(key), modulus).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns, in one pass over the texts.

    Without labels of both kinds there is no model, and all rows are accepted.
    """
    model = learn(docs, labels, modulus, key=key, text=text)
    if model is None:
        return docs
    named = docs.select(F.struct(*docs.columns).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return with_statistics(named, "__text").where(compiled(model) >= threshold).select("__row.*")
