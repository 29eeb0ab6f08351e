"""Shared plumbing of the training-data operators.

* ``shared_dir`` / ``save`` - tables written to the folder that every executor and the driver can reach, so a lost
  executor costs a re-read and never a recomputation of the whole lineage.
* ``pack_blocks`` / ``unpack`` - rows bundled into compressed blocks of bounded size with an identity that is fixed by
  writing them once. Operators that gather corpus statistics send one small blob per (block, hash range) through the
  shuffle instead of one row per n-gram and get their answer back by block.
* ``Tokens`` and the window hashes - words of a block as arrays, with 64-bit hashes of any run of words.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text in a block; bounds what a task holds of the corpus at a time.
BLOCK_BYTES = 4 << 20
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None
BLOCK_SCHEMA = "block long, rows_ipc binary"
BLOB_SCHEMA = "part int, block long, kind int, blob binary"

#: Saved tables: session, folder, and the thread that has saved it.
_written: list[tuple[SparkSession, str, int]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one on a single machine, an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", known)
        _written.append((spark, known, 0))
    return known.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path, _ in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: whoever owns the folder clears it
            return


atexit.register(_sweep)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path, threading.get_ident()))
    df.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Save what ``make`` returns and delete all tables that this thread has saved on the way to it."""
    mark, own = len(_written), threading.get_ident()
    out = save(make(), name)
    for entry in [e for e in _written[mark:] if e[2] == own][:-1]:
        _delete(*entry[:2])
        _written.remove(entry)
    return out


def let_go(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more, and let Spark clear shuffle files of finished steps."""
    for table in tables:
        for file in {f.rpartition("/")[0] for f in table.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Partitions of a shuffle at most; blocks of documents in a task where blocks and answers meet.
MOST_PARTITIONS, BLOCKS_TOGETHER = 20_000, 16


def spread(df: DataFrame, parts: int, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` to as many partitions as there are ranges, so that tasks don't grow with the data."""
    return df.repartition(min(parts, MOST_PARTITIONS), key)


def parts_for(total: int, each: int) -> int:
    """How many hash ranges keep a range near ``each`` entries; at least 16, so that small inputs spread as well."""
    return int(max(16, -(-total // each)))


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """True where crc32 of the id as text has the remainder; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


# ------------------------------------------------------------------------------------------------ blocks of rows


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack_blocks(df: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Bundle all rows and columns of ``df`` into blocks of about ``block_bytes`` of text and write them once.

    A row longer than a block gets a block of its own. No shuffle: a task cuts its own input.
    """

    small_batches(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = pa.RecordBatch.from_pydict({"block": pa.array([base + seq], pa.int64()), "rows_ipc": pa.array([_ipc(whole)], pa.binary())})
            seq, held, size = seq + 1, [], 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(lengths + 64), 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + block_bytes - size, side="right")))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - done)
                start = stop
                if size >= block_bytes * 0.9 or start < batch.num_rows:
                    yield flush()
        if held:
            yield flush()

    return save(df.mapInArrow(trimmed(cut), BLOCK_SCHEMA), "blocks")


def trim() -> None:
    """Give memory that Python, numpy and Arrow hold but don't use back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def trimmed(run):
    """``run`` over the batches of a task, with a trim at the task's end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most 1000 rows, unless the session has its own setting: a batch exists
    several times over, in the JVM, in transfer and in Python."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(text)))).as_py() or 0
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each: what is worked out of a text can be many times its size."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False) + 64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def each_block(blocks: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work(block, table) -> iterator of record batches`` over every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block"), batch.column("rows_ipc"), strict=True):
                yield from work(block.as_py(), unpack(blob.as_py()))
                trim()

    return blocks.mapInArrow(run, schema)


def with_answers(blocks: DataFrame, answers: DataFrame, work, schema: str | StructType) -> DataFrame:
    """Bring the answers back to their blocks: ``work(block, table, answer table) -> pa.Table``.

    Each side is shuffled once by block; a block's answers are bounded by its own words.
    """
    empty = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left.column("block")[0].as_py(), unpack(left.column("rows_ipc")[0].as_py()), right) if left.num_rows else empty
        trim()
        return out

    wanted = -(-blocks.count() // BLOCKS_TOGETHER)  # a count of blocks, of which a row has megabytes, reads no block
    if wanted > int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        blocks, answers = spread(blocks, wanted, "block"), spread(answers, wanted, "block")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def blobs_of(answer: pa.Table) -> dict[int, list[bytes]]:
    """Blobs of a BLOB_SCHEMA table by kind."""
    found: dict[int, list[bytes]] = {}
    for kind, blob in zip(answer.column("kind").to_pylist(), answer.column("blob").to_pylist(), strict=True):
        found.setdefault(kind, []).append(blob)
    return found


# -------------------------------------------------------------------------------------------- arrays in blobs


def pack_arrays(arrays: dict[str, np.ndarray | pa.Array]) -> bytes:
    """Arrays of one length as one compressed blob."""
    return _ipc(pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in arrays.items()}))


def read_arrays(blob: bytes) -> dict[str, np.ndarray]:
    table = unpack(blob)
    return {k: table.column(k).to_numpy() for k in table.column_names}


def blobs_by_part(block: int, kind: int, key: np.ndarray, parts: int, arrays: dict[str, np.ndarray], base: int = 0) -> Iterator[pa.RecordBatch]:
    """One row for each hash range that ``key`` (uint64, spread evenly) meets, with the arrays' entries of that range.

    base: number of the first range.
    """
    if not len(key):
        return
    part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    starts, stops = np.r_[0, cuts], np.r_[cuts, len(part)]
    sorted_arrays = {k: v[order] for k, v in arrays.items()}
    yield blob_rows([(base + int(part[a]), block, kind, pack_arrays({k: v[a:b] for k, v in sorted_arrays.items()})) for a, b in zip(starts, stops, strict=True)])


def blob_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    part, block, kind, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "block", "kind", "blob"])


def gather_parts(blobs: DataFrame, work, parts: int) -> DataFrame:
    """All blobs of a hash range meet in one task: ``work({name: array}, source) -> [(block, kind, arrays)]``.

    ``source`` has the block of every entry. A range is bounded by the caller's choice of ``parts``, the number of ranges.
    """

    def run(group: pa.Table) -> pa.Table:
        blocks, found = group.column("block").to_pylist(), [read_arrays(b) for b in group.column("blob").to_pylist()]
        merged = {k: np.concatenate([x[k] for x in found]) for k in found[0]}
        sizes = [len(next(iter(x.values()))) for x in found]
        rows = [(0, int(b), kind, pack_arrays(a)) for b, kind, a in work(merged, np.repeat(np.array(blocks, np.int64), sizes))]
        trim()
        return pa.Table.from_batches([blob_rows(rows)])

    return spread(blobs, parts, "part").groupBy("part").applyInArrow(run, BLOB_SCHEMA)


def by_block(block: np.ndarray, kind: int, arrays: dict[str, np.ndarray]) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """Split entries by the block that asked for them."""
    if not len(block):
        return
    order = np.argsort(block, kind="stable")
    block = block[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(block)], strict=True):
        yield int(block[a]), kind, {k: v[order[a:b]] for k, v in arrays.items()}


def joined(found: dict[int, list[bytes]], kind: int, name: str, dtype) -> np.ndarray:
    """One array of all answers of a kind."""
    return np.concatenate([read_arrays(b)[name] for b in found[kind]]) if kind in found else np.empty(0, dtype)


def squeeze(values: np.ndarray) -> bytes:
    """Ascending uint64 values in few bytes: differences, by byte plane, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return pa.compress(np.ascontiguousarray(steps.T).tobytes(), codec="zstd", asbytes=True)


def expand(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


# --------------------------------------------------------------------------- counts of hashes over the whole corpus
#
# A block sends its distinct hashes, ascending, with its own counts, cut into equal hash ranges; a range's totals come
# back in the same order, so no hash travels twice. Every block sends a hash once: a hot one costs a row a block.

COUNT_SCHEMA = "part int, block long, n int, blob binary, counts binary"
TOTAL_SCHEMA = "block long, part int, n int, totals binary, distinct long, entries long"


def ranges_of(sorted_hashes: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """parts + 1 positions at which the equal ranges of hashes of so many bits begin."""
    width = (1 << bits) // parts
    return np.r_[0, np.searchsorted(sorted_hashes, np.arange(1, parts, dtype=np.uint64) * np.uint64(width)), len(sorted_hashes)].astype(np.int64)


def count_rows(block: int, hashes: np.ndarray, counts: np.ndarray, parts: int, base: int = 0, bits: int = 64) -> Iterator[pa.RecordBatch]:
    cuts = ranges_of(hashes, parts, bits)
    some = [i for i in range(parts) if cuts[i + 1] > cuts[i]]
    if some:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([base + i for i in some], pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([int(cuts[i + 1] - cuts[i]) for i in some], pa.int32()),
                pa.array([squeeze(hashes[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()),
                pa.array([pa.compress(counts[cuts[i] : cuts[i + 1]].astype(np.uint32).tobytes(), codec="zstd", asbytes=True) for i in some], pa.binary()),
            ],
            names=["part", "block", "n", "blob", "counts"],
        )


def totals(counted: DataFrame, parts: int) -> DataFrame:
    """Sum of every hash over all blocks, in ``parts`` hash ranges."""

    def run(group: pa.Table) -> pa.Table:
        ns = group.column("n").to_pylist()
        hashes = np.concatenate([expand(b, n) for b, n in zip(group.column("blob").to_pylist(), ns, strict=True)])
        counts = np.concatenate([np.frombuffer(pa.decompress(c, 4 * n, codec="zstd", asbytes=True), np.uint32) for c, n in zip(group.column("counts").to_pylist(), ns, strict=True)]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        first = np.r_[True, np.diff(hashes[order]) != 0]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        sums = np.add.reduceat(counts[order], starts)
        told, cuts = sums[which].astype(np.uint32), np.cumsum([0, *ns])
        used = len(ns)
        del hashes, counts, order, first, which
        trim()
        return pa.table(
            {
                "block": group.column("block").cast(pa.int64()), "part": group.column("part").cast(pa.int32()), "n": group.column("n").cast(pa.int32()),
                "totals": pa.array([pa.compress(told[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                "distinct": pa.array([int((sums > 0).sum())] + [0] * (used - 1), pa.int64()), "entries": pa.array([int(sums.sum())] + [0] * (used - 1), pa.int64()),
            }
        )

    return spread(counted, parts, "part").groupBy("part").applyInArrow(run, TOTAL_SCHEMA)


def told_totals(answer: pa.Table, hashes: np.ndarray, parts: range) -> np.ndarray:
    """The totals of a block's ascending hashes, as ``totals`` has sent them back for these ranges."""
    rows = sorted(x for x in zip(answer.column("part").to_pylist(), answer.column("n").to_pylist(), answer.column("totals").to_pylist(), strict=True) if x[0] in parts)
    out = np.concatenate([np.frombuffer(pa.decompress(t, 4 * n, codec="zstd", asbytes=True), np.uint32) for _, n, t in rows]) if rows else np.empty(0, np.uint32)
    if len(out) != len(hashes):
        raise ValueError(f"{len(out)} totals for {len(hashes)} hashes")
    return out.astype(np.int64)


# ------------------------------------------------------------------------------------------------ words and hashes


def texts_of(table: pa.Table, text: str, lower: bool) -> list[bytes]:
    """UTF-8 of every text, null as empty; A-Z lower-cased on demand (other letters stay)."""
    column = table.column(text).cast(pa.binary()).to_pylist()
    return [(x or b"").lower() if lower else x or b"" for x in column]


class Tokens:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a list of texts: ``ids`` into ``vocab``, text i at ``ends[i-1]:ends[i]``."""

    def __init__(self, texts: list[bytes]) -> None:
        split = [t.split() for t in texts]  # bytes.split() parts at exactly these six characters
        flat = list(chain.from_iterable(split))
        self.ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64)[: len(split)]
        index = dict.fromkeys(flat)
        for i, word in enumerate(index):
            index[word] = i
        self.vocab = list(index)
        self.ids = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        self.n = len(flat)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every distinct word."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocab), np.uint64, len(self.vocab))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 1 << 64)


class RunHashes:
    """Hash of any run of words in constant time: differences of a prefix polynomial, shifted to a common origin."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _UNDO, np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(down)
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(words) * up[:n])]

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        """Of every start, across text borders as well; the caller masks those."""
        n = len(self.sums) - 1
        if n < length:
            return np.empty(0, np.uint64)
        return mix((self.sums[length:] - self.sums[: n + 1 - length]) * self.down[: n + 1 - length] + np.uint64(length))
