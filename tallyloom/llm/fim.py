"""Fill-in-the-middle: a text is cut at two unit borders, and its middle is moved to the end behind marks.

One kernel works on all rows of an Arrow batch at once, on the bytes of its UTF-8 buffer: a lookup gives every byte its
class, the classes of adjacent bytes tell where a unit ends, and the cumulative sum of these ends, less what it is at the
start of a text, numbers the units of each text. One ``searchsorted`` over the sums then finds both cuts of every row.
The three parts of a text are views of the same buffer, put together by Arrow.

Draws come from the sha256 of ``seed:id``: they depend on nothing else, so a rerun or a lost executor changes no row.

Defined results: null and empty texts are ``plain`` with no units; so are texts that contain a mark, which could not be
restored; a null id is drawn as empty text; repeated rows get one result each; a text of any length is worked on whole
(about fifteen times its bytes are held); an empty table gives an empty table; extra columns are ignored. Line ends
other than \\n end no line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.llm.common import slices, small_batches, trimmed

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
_INNER, _LEAD, _SPACE, _NEWLINE = range(4)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _LEAD, np.uint8)
    table[0x80:0xC0] = _INNER  # continues a code point
    table[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
    table[0x0A] = _NEWLINE
    return table


CLASSES = _byte_classes()
_BEFORE, _AFTER = np.divmod(np.arange(16), 4)
_BLANK_BEFORE, _BLANK_AFTER = _BEFORE >= _SPACE, _AFTER >= _SPACE
#: Does a unit end between bytes of these classes? Index: 4 * class before + class after.
BORDERS = {"line": _BEFORE == _NEWLINE, "word": _BLANK_BEFORE & ~_BLANK_AFTER, "char": _AFTER != _INNER}


def _large(column: pa.Array) -> pa.Array:
    """Nulls as empty texts, offsets of 64 bits, one contiguous buffer."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of large strings."""
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return borders, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def parts(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` as strings, without a copy."""
    return pa.Array.from_buffers(pa.large_string(), len(borders) - 1, [None, pa.py_buffer(np.ascontiguousarray(borders, np.int64)), pa.py_buffer(data)])


def _joined(*pieces: pa.Array | str) -> pa.Array:
    """Rows of pieces put together; a ``str`` stands in every row."""
    return pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (*pieces, "")))


def unit_sums(data: np.ndarray, borders: np.ndarray, unit: str) -> np.ndarray:
    """Number of unit ends up to and with each byte between the first and the last border."""
    low, high = int(borders[0]), int(borders[-1])
    kinds = CLASSES[data[low:high]]
    ends = np.zeros(len(kinds), bool)
    ends[:-1] = BORDERS[unit][kinds[:-1] * 4 + kinds[1:]]
    ends[borders[1:][np.diff(borders) > 0] - 1 - low] = True
    return np.cumsum(ends, dtype=np.int64 if len(ends) >= 1 << 31 else np.int32)


def cuts(data: np.ndarray, borders: np.ndarray, unit: str, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, cut, cut) of every text: the byte positions after ``first % (units + 1)`` and ``second % (units + 1)`` units."""
    low, sums = int(borders[0]), unit_sums(data, borders, unit)
    so_far = np.r_[0, sums][borders - low].astype(np.int64)
    units, base = np.diff(so_far), so_far[:-1]
    wanted = np.sort(np.stack([first % (units + 1), second % (units + 1)]), axis=0)
    found = np.searchsorted(sums, (base + wanted).astype(sums.dtype), side="left") + 1 + low
    found = np.where(wanted == 0, borders[:-1], found)
    return units, found[0], found[1]


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks of which none can arise where another meets a text."""
    for a in marks:
        for b in marks:
            if not a or len(set(marks)) < len(marks) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                raise ValueError("marks must be different, not empty and must not overlap")
    return marks


def draws(key: Column, seed: int) -> Column:
    """Four numbers below 2**32 from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 100, spm: int = 50, seed: int = 7, unit: str = "line", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row.

    n: units of the text; rate: percentage of rows to transform; spm: percentage of those whose suffix comes first;
    unit: ``line``, ``word`` (with the white space behind it) or ``char``.
    """
    (p, s, m), names = checked(marks), ["n", "form", "prefix_chars", "middle_chars", "output"]
    small_batches(docs.sparkSession)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, drawn = _large(batch.column(1)), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).T
        borders, data = buffers(texts)
        units, one, two = cuts(data, borders, unit, drawn[0], drawn[1])
        pieces = parts(data, np.r_[np.stack([borders[:-1], one, two], axis=1).ravel(), borders[-1]])
        prefix, middle, suffix = (pieces.take(pa.array(np.arange(k, len(pieces), 3))) for k in range(3))
        plain = (np.diff(borders) == 0) | (drawn[2] % 100 >= rate)
        for mark in marks:
            plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        first = drawn[3] % 100 < spm
        form = np.where(plain, PLAIN, np.where(first, SPM, PSM))
        as_spm, as_psm = _joined(s, suffix, p, prefix, m, middle), _joined(p, prefix, s, suffix, m, middle)
        output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(first), as_spm, as_psm))
        chars = [pa.array(pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64), mask=plain) for x in (prefix, middle)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(units), pa.array(form, pa.string()), *chars, output.cast(pa.string())], names=[key, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield kernel(part)

    types = [LongType(), StringType(), LongType(), LongType(), StringType()]
    rows = docs.select(key, text, draws(F.col(key), seed).alias("__drawn"))
    return rows.mapInArrow(trimmed(run), StructType([docs.schema[key], *(StructField(n, t) for n, t in zip(names, types, strict=True))]))


def restore(rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``rows`` with the texts that the outputs were made of, from output and form alone."""
    p, s, m = checked(marks)
    small_batches(rows.sparkSession)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _large(batch.column(batch.schema.get_field_index(output)))
        forms = np.array(batch.column(batch.schema.get_field_index(form)).to_pylist(), object)
        borders, data = buffers(made)
        start, stop, plain, spm = borders[:-1], borders[1:], forms == PLAIN, forms == SPM
        at = {x: start + pc.find_substring(made, x).to_numpy(zero_copy_only=False) for x in (p, s, m)}
        head, second = np.where(spm, len(s.encode()), len(p.encode())), np.where(spm, at[p], at[s])
        second_size = np.where(spm, len(p.encode()), len(s.encode()))
        # mark, part, mark, part, mark, middle; of plain rows the second piece is all
        edges = np.stack([start, np.where(plain, start, start + head), *(np.where(plain, stop, x) for x in (second, second + second_size, at[m], at[m] + len(m.encode())))], axis=1)
        pieces = parts(data, np.r_[edges.ravel(), borders[-1]])
        row = 6 * np.arange(batch.num_rows)
        prefix, suffix, middle = (pieces.take(pa.array(row + k)) for k in (np.where(spm, 3, 1), np.where(spm, 1, 3), 5))
        text = _joined(prefix, middle, suffix).cast(pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, into])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, output):
                yield kernel(part)

    return rows.mapInArrow(trimmed(run), StructType([*rows.schema.fields, StructField(into, StringType())]))


def digests(docs: DataFrame, **options) -> DataFrame:
    """``transform`` with the sha256 of the output and of the restored text in their place."""
    made = restore(transform(docs, **options))
    return made.select(*(c for c in made.columns if c not in ("output", "restored")), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
