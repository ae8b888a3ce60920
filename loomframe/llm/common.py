"""Shared pieces of the training-data operators: table access, the shared folder, text splitting over Arrow buffers."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, materialize, shared_dir

__all__ = ["fresh_path", "materialize", "shared_dir"]


def release(*tables: DataFrame) -> None:
    """Remove tables that materialize() wrote, from the shared folder. Nothing that is still to run may read them."""
    for t in tables:
        spark, shared = t.sparkSession, shared_dir(t.sparkSession)
        for parent in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            # the setting may leave the file system out; names of files have it
            if path.getParent().equals(fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(shared))):
                fs.delete(path, True)


def with_row_id(docs: DataFrame) -> DataFrame:
    """docs plus _rid, a long of each row's own that is the same whenever it is asked for: number of its file and place in it.

    Where docs is not a scan of files, it is written once. Files are numbered by a table of a row for each file.
    """
    try:
        x = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        files = x.select("_file").distinct().withColumn("_number", F.row_number().over(Window.orderBy("_file")).cast("long"))
        files = materialize(files, "files")
    except AnalysisException:
        return materialize(docs.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    return x.join(files, "_file").select(*[F.col(f"`{c}`") for c in docs.columns], F.shiftleft("_number", 40).bitwiseOR(F.col("_at")).alias("_rid"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once: the JVM holds them once or twice for each task, the worker too.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to ARROW_BYTES, if it is higher. The limit is read when a plan runs, so it stays lowered."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = "".join(c for c in spark.conf.get(name) if c.isdigit())  # `67108864b`
    if not digits or int(digits) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a Python object per row; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
        column = column.cast(pa.string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Parts of a record batch with about `limit` bytes of text each (one row at least), so that numpy temporaries stay bounded."""
    col = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_bytes(col)
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes with is_word[byte]; runs end at row ends."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = w[cut]
    last[cut - 1] = w[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Ranges of up to so many bytes are hashed side by side, eight bytes at a step; longer ones one by one.
SIDE = 1024


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; bytes past the end are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def run_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for many ranges at once, equal for equal bytes wherever they stand.

    Eight bytes at a time are mixed into the state, which starts from the length; ranges of over SIDE bytes take BLAKE2b.
    """
    size = end - start
    h = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(size):
        return h
    view = _eights(data)
    long = np.flatnonzero(size > SIDE)
    most = int(np.where(size > SIDE, 0, size).max(initial=0))
    live = np.flatnonzero(size <= SIDE) if most > 8 or len(long) else slice(None)
    with np.errstate(over="ignore"):
        for k in range(0, most, 8):
            if k:
                live = live[size[live] > k]
            part = view[start[live] + k] & _TAIL[np.minimum(size[live] - k, 8)]
            h[live] = mix64((h[live] ^ part) * _ODD + part)
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


_ODD = np.uint64(0xD6E8FEB86659FD93)


def wide_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all stretches of `size` bytes (a multiple of 8), by first byte: hashes of stretches of 8, 16, 32, ... bytes, put together."""
    if size % 8 or size < 8:
        raise ValueError("size must be a multiple of 8")
    out, done = None, 0
    level, width = mix64(_eights(data)[: max(0, len(data) - 7)] + np.uint64(0x9E3779B97F4A7C15)), 8
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                piece = level[done : done + max(0, len(data) - size + 1)]
                out = piece.copy() if out is None else mix64(out * _ODD + piece)
                done += width
            if done == size:
                return out
            level = mix64(level[: max(0, len(level) - width)] * _ODD + level[width:])
            width *= 2


_libc = None


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, and at its end what the worker has freed goes back to the system: workers stay alive between stages."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        global _libc
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                _libc = _libc or ctypes.CDLL("libc.so.6")
                _libc.malloc_trim(0)
            except (OSError, AttributeError):  # another C library: it keeps what it keeps
                pass

    return wrapped
