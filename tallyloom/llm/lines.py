"""Quality rules: base rules of each text, and lines that many documents of one host share.

Lines are normalised (A-Z lower-cased, white space squeezed, numbers as 0) and hashed. For each host the distinct
documents with a line are counted; a line is boilerplate above ``share`` of the host's distinct documents, and above
``least`` of them. Boilerplate lines are removed, and a document that keeps less than ``keep`` of its words is rejected
as depleted, as is one that fails the base rules.

Exact copies are not many documents: a document is known by the hash of its whole text, for every line and for the
host's total alike, so a page that was copied a thousand times is not boilerplate of itself. Texts that differ, near
copies included, are distinct documents.

Lines are coded, counted and looked up in DataFrame operations; Python works out the base rules alone. The boilerplate
lines of a host, at most (lines in a document) / share, are one array that is joined to the host's documents: Spark
broadcasts the hosts' arrays where they are small and parts a hot host's documents where they aren't.

Defined results: null and empty texts have no words and fail the base rules; a null host is a host of its own; repeated
rows get one result each; a text of any length is worked on whole; a line in exactly ``share`` of the documents, or in
exactly ``least``, stays, and a document that keeps exactly ``keep`` of its words is kept; an empty table gives an empty
table; extra columns pass through ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tallyloom.llm.common import RunHashes, Tokens, mix, save, slices, small_batches, trimmed

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_code(line: bytes) -> int:
    """Hash of a normalised line, as a signed long; 0 for a line without a word."""
    words = re.sub(rb"[0-9]+", b"0", line).lower().split()
    code = xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
    return code - (1 << 64) if code >> 63 else code


def line_codes(text: Column) -> Column:
    """``line_code`` of every line of a text: array<long>."""
    plain = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[0-9]+", "0"), ascii_uppercase, ascii_lowercase)
    lines = F.split(F.regexp_replace(plain, r"[\x20\x09\x0B-\x0D]+", " "), "\n", -1)
    return F.transform(F.transform(lines, F.trim), lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x)))


def shared_lines(docs: DataFrame, host: str, text: str, share: float, least: int) -> DataFrame:
    """(host, line): the boilerplate lines. Distinct (host, line, document) first, then counts: no key is hot."""
    codes = F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), line_codes(F.col(text))))
    rows = docs.select(F.col(host).alias("host"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("doc"), F.explode(codes).alias("line")).distinct()
    counts = save(rows.groupBy("host", "line").agg(F.count("*").alias("n")).where((F.col("n") > least) | (F.col("line") == 0)), "lines")
    sizes = counts.where("line = 0").select(F.col("host").alias("h"), F.col("n").alias("size"))
    return counts.where("line <> 0").join(sizes, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.col("size") * share).select("host", "line")


def base_counts(texts: list[str | None]) -> np.ndarray:
    """COUNTS of every text, in columns."""
    out = np.zeros((len(COUNTS), len(texts)), np.int64)
    raw = [(t or "").encode() for t in texts]
    tokens = Tokens(raw)
    out[0] = tokens.ends - tokens.starts
    for i, t in enumerate(texts):
        if t:
            out[1, i] = len(t) - sum(map(t.count, " \t\n\x0b\x0c\r"))
            out[2, i] = sum(map(t.count, "#*$%&|<>"))
            lines = [x for x in raw[i].split(b"\n") if x and not x.isspace()]
            out[3, i] = len(lines) - len(set(lines))
    if tokens.n >= 3:
        doc = np.repeat(np.arange(len(texts)), out[0])
        start = np.flatnonzero(np.arange(tokens.n - 2) + 3 <= tokens.ends[doc[: tokens.n - 2]])
        code = RunHashes(tokens.hashes()[tokens.ids]).windows(3)[start] ^ mix(doc[start].astype(np.uint64) + np.uint64(1))
        _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        twice = start[count[inverse] > 1]
        edge = np.zeros(tokens.n + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 3, -1)
        out[4] = np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=len(texts))
    return out


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", share: float = 0.05, least: int = 10, keep: float = 0.5, cleaned: bool = False) -> DataFrame:
    """(key, host, COUNTS, n_shared_words, base_failed, kept); ``cleaned``: with all columns of ``docs``, whose names must
    differ from these, and the text without its boilerplate lines."""
    docs = docs if cleaned else docs.select(key, host, text)
    found = save(shared_lines(docs, host, text, share, least).groupBy("host").agg(F.collect_list("line").alias("__shared")).withColumnRenamed("host", "__host"), "shared-lines")
    at = F.filter(F.transform(line_codes(F.col(text)), lambda x, i: F.when(F.array_contains("__shared", x), i)), lambda i: i.isNotNull())
    rows = docs.join(found, F.col(host).eqNullSafe(F.col("__host")), "left").select(*docs.columns, F.when(F.col("__shared").isNotNull(), at).alias("__lines"))
    small_batches(docs.sparkSession)

    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, text)):
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            texts = column[text].to_pylist()
            counts, gone, clean = base_counts(texts), np.zeros(len(texts), np.int64), []
            for i, (t, mine) in enumerate(zip(texts, column["__lines"].to_pylist(), strict=True)):
                if mine:
                    bad, parts = set(mine), t.split("\n")
                    gone[i] = sum(len(parts[k].encode().split()) for k in bad)
                    t = "\n".join(x for k, x in enumerate(parts) if k not in bad)
                clean.append(t)
            failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
            kept = ~failed & (counts[0] - gone >= keep * counts[0])
            arrays = [*(column[c] for c in others), *([pa.array(clean, column[text].type)] if cleaned else []), *(pa.array(x) for x in counts), pa.array(gone), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    schema = StructType([*(docs.schema[c] for c in others), *([docs.schema[text]] if cleaned else []), *(StructField(c, LongType()) for c in (*COUNTS, "n_shared_words")), StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])
    return rows.mapInArrow(trimmed(run), schema)


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, without their boilerplate lines, in the columns of ``docs``."""
    renamed = docs.select(*(F.col(c).alias(f"d_{c}") for c in docs.columns))
    names = {k: f"d_{options.pop(k, v)}" for k, v in (("key", "doc_id"), ("host", "source"), ("text", "text"))}
    return judge(renamed, **names, **options, cleaned=True).where("kept").select(*(F.col(f"d_{c}").alias(c) for c in docs.columns))
