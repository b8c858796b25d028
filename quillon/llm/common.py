"""What the training-data operators share: scratch tables, Arrow columns, word scanning and hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a session on the driver's machine alone
    gets a temporary one; on a cluster that would be seen by no executor, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/quillon/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def persist(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a written table in the shared folder: a lost executor costs a reread, not a recomputation."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(*tables: DataFrame) -> None:
    """Deletes tables of persist() that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._scratch_path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this application; results that still read them must have been written before."""
    _delete(spark, f"{scratch_dir(spark)}/quillon/{spark.sparkContext.applicationId}")


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches of at most `most` bytes, where the session has Spark's default of 64 MB: a task holds several at once, its own and its
    Python worker's in both directions, and rows with whole texts fill them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m", "64MB"):
        spark.conf.set(name, most)


def give_back() -> None:
    """Returns what a task has freed to the system, so that an idle Python worker does not hold it beside its executor's next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it keeps what it keeps


def giving_back(run):
    """A function of a task's batches that gives back what it freed when they end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column, nulls as empty, without copying the values where possible."""
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 21):
    """Row ranges (a, b) of about `most` bytes each; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: xor-shifts and odd multiplications modulo 2**64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII bytes that are no letter, digit or apostrophe; bytes of other scripts count as letters.
_MARK = np.array([b < 128 and not (chr(b).isalnum() or b == 0x27) for b in range(256)])
_BASE = 0xB5297A4D3F84D5B5
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            k, step = 1, base
            while k < size:  # doubling: out[k:2k] = out[:k] * base**k
                out[k : 2 * k] = out[:k] * np.uint64(step)
                k, step = 2 * k, step * step % (1 << 64)
            _POWERS[key] = out
    return _POWERS["up"], _POWERS["down"]


def scan_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, starts): a 64-bit hash of every word of the rows data[offsets[i]:offsets[i+1]], its row and its first byte.

    marks: ASCII punctuation separates words too. A word's hash is a polynomial of its bytes modulo 2**64 taken from one prefix sum over all rows, then mixed.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = ~(_MARK if marks else _SPACE)[data]
    edge = np.empty(n, bool)
    edge[0] = True
    np.logical_not(is_word[:-1], out=edge[1:])
    firsts = offsets[:-1][offsets[:-1] < n]
    edge[firsts] = True  # a row's first byte never continues a word of the row before
    starts = np.flatnonzero(edge & is_word)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(is_word[1:], out=last[:-1])
    last[firsts[firsts > 0] - 1] = True
    ends = np.flatnonzero(last & is_word)
    up, down = _powers(n + 1)
    total = np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    hashes = mix((total[ends] - before) * down[starts] + (ends - starts + 1).astype(np.uint64) * _ODD)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return hashes, rows, starts
