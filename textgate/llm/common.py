"""What the training-data operators share: byte-level text kernels, Arrow helpers and written intermediate tables.

Kernels work on the UTF-8 bytes of many texts at once (an Arrow string column is one byte buffer plus offsets), so
no per-character Python runs. Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased first.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a kernel takes at a time; one longer text goes alone.
SLICE_BYTES = 500_000
#: Bytes of an Arrow batch: the JVM and the worker each hold a few copies of one for every task.
BATCH_BYTES = 4_000_000
#: Spark's setting by which a query deletes its shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[IS_SPACE] = 0  # white space adds nothing to the word before it
_POWER = np.cumprod(np.full(1 << 14, 0x9E3779B97F4A7C15, np.uint64))
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. A session without one can't share tables between executors: that is an error."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        said = getattr(shared_dir, "own", None)  # one process, one disk
        if not said:
            said = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="textgate-")
    return said.rstrip("/")


@contextlib.contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Queries begun here delete their shuffle files when they end. Otherwise these stay until the driver happens to collect its garbage."""
    said = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if said is None else spark.conf.set(CLEANUP, said)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage is cut and any executor can read it after a loss. Of its shuffles nothing stays."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with no_shuffles_left(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written(). Only for tables whose every use has itself been written: nothing reads them again,
    a lost executor's work included."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], last: Callable[[], None] = lambda: None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at the end of a task calls last() and gives freed memory back to the system: workers are used again by
    later operators, and an executor's memory is that of all its workers."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            last()
            give_back()

    return whole


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, last: Callable[[], None] = lambda: None) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded bytes, however long the texts, and a tidy end of each task. The
    session's own limit stays if it is lower."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    said = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name))
    if not 0 < said <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(tidy(run, last), schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (and the last ends). Null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of text, at least one row each."""
    _, offsets = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterator[pa.RecordBatch], text: str, least: int) -> Iterator[pa.RecordBatch]:
    """Successive batches put together until they have `least` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(text_buffer(batch.column(text))[1][-1])
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word, 64-bit hash of each word, index of each text's first word and of the last's end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[raw] if lower else raw
    solid = ~IS_SPACE[low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[:-1]
    edge = edge[edge < len(raw)]
    first[edge] = solid[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    value = _BYTE[low[starts[0] :]]
    value *= _POWER[place & (len(_POWER) - 1)]
    if len(place) and int(place.max()) >= len(_POWER):  # a word longer than the table: its further rounds differ
        value *= (np.uint64(2) * (place >> 14).astype(np.uint64) + np.uint64(1))
    return starts, mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, offsets)


def word_ends(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The byte after each word."""
    space = IS_SPACE[raw]
    edge = offsets[1:-1]
    stop = np.flatnonzero(space)
    ends = np.append(stop, len(raw))[np.searchsorted(stop, starts)] if len(starts) else starts
    if len(edge) and len(starts):
        following = offsets[np.searchsorted(offsets, starts, "right")]
        ends = np.minimum(ends, following)
    return ends


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words within a text, index of each text's first run and of the last's end).

    A text of 1 to k - 1 words has its whole sequence as one run; without words it has none.
    """
    n = np.diff(bounds)
    total = len(hashes)
    if total >= k:
        run = np.zeros(total - k + 1, np.uint64)
        for j in range(k):
            run += hashes[j : total - k + 1 + j] * _SHINGLE[j % 64] + np.uint64(j // 64)
        run = mix(run)
    else:
        run = np.zeros(0, np.uint64)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=out[1:])
    short = np.flatnonzero((n > 0) & (n < k))
    base = np.repeat(bounds[:-1] - out[:-1], counts) + np.arange(out[-1])
    got = np.zeros(out[-1], np.uint64)
    whole = np.repeat(n >= k, counts)
    got[whole] = run[base[whole]]
    for i in short:
        seq = hashes[bounds[i] : bounds[i + 1]]
        got[out[i]] = mix((seq * _SHINGLE[: len(seq)]).sum(keepdims=True) + np.uint64(0x5851F42D4C957F2D * len(seq) % (1 << 64)))[0]
    return got, out


def letters(column) -> F.Column:
    """Whether a text has a letter; null has none."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).rlike(r"\p{L}")
