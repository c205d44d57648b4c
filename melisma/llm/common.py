"""Tokens, hashes and packed arrays that the operators share; all of it works on whole Arrow string buffers."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import pickle
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 256 << 10
_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Everything but ASCII letters and digits and the bytes of other scripts.
PUNCTUATION = ~(((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128))
BASE = 0x9E3779B97F4A7C15


_LOCAL: list[str] = []


def durable(df: DataFrame, parts: int = 0) -> DataFrame:
    """Cut the lineage: write df as Parquet into the folder that the cluster shares (spark.checkpoint.dir) and read it again.

    A folder of our own is taken only if none is set and everything runs in one process. Unlike after checkpoint(), sizes are those
    of the files, so iterative plans don't multiply old estimates. A table known to be small can be written by fewer tasks. The
    files go when the session's file system closes, or earlier by discard().
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="melisma-"))
        shared = _LOCAL[0]
    path = f"{shared}/melisma-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path)
    _WRITTEN.get([]).append(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: contextvars.ContextVar[list] = contextvars.ContextVar("written")


@contextlib.contextmanager
def written():
    """Collects the paths of the tables that durable() writes meanwhile."""
    before = _WRITTEN.set(paths := [])
    try:
        yield paths
    finally:
        _WRITTEN.reset(before)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of durable() that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy() -> None:
    """Give the memory that a task no longer uses back to the system: Spark's Python workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(function):
    """The function of one table, with tidy() once its own arrays have gone: a call from within would find all of them in use."""

    def held(table):
        try:
            return function(table)
        finally:
            tidy()

    return held


#: A table of ids up to so many rows goes to every task.
BROADCAST_ROWS = 1 << 18


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """The rows of docs that no row of gone (a stored table of ids) matches. Texts are shuffled only if gone has over BROADCAST_ROWS rows."""
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, on, "left_anti")


def carried(spark: SparkSession, value):
    """A function that gives `value` on any executor; classes of this subpackage travel along by value."""
    blob = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(blob.value)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base, np.uint64)], dtype=np.uint64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection for each salt)."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64(salt)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
        return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; null is the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, name: str = "text", limit: int = PIECE_BYTES):
    """Slices of a batch with about `limit` bytes of text each; a longer text has a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(text_bytes(batch.column(name))[1])
    done = np.cumsum(sizes)
    at = 0
    while at < n:
        before = done[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(done, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """Runs of bytes other than white space (\\x20 and \\x09-\\x0D, or what `space` marks) in the A-Z lower-cased texts.

    Returns the words' first bytes, the bytes after them, each text's range among the words (n + 1 offsets) and 64-bit
    hashes of the words.
    """
    low = LOWER[data]
    solid = ~space[data]
    filled = offsets[:-1] < offsets[1:]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    heads = offsets[:-1][filled]
    begin[heads] = solid[heads]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    tails = offsets[1:][filled] - 1
    end[tails] = solid[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets), word_hashes(low, solid, starts, ends)


def word_hashes(low: np.ndarray, solid: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words' bytes, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    with np.errstate(over="ignore"):
        terms = (low[solid].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, first))


def grams(hashes: np.ndarray, doc_words: np.ndarray, n: int):
    """Hashes of n consecutive words within a text, and the text of each."""
    count = np.diff(doc_words)
    own = np.maximum(count - n + 1, 0)
    texts = np.repeat(np.arange(len(count)), own)
    at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(doc_words[:-1], own)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k, p in enumerate(powers(n, 0x9FB21C651E98DF25)):
            h += hashes[at + k] * p
    return mix(h, n), texts, at


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an array: sorted values leave their upper planes nearly constant, which Spark's codec shrinks."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes() if len(values) else b""


def unpack(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def raw(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(blob, dtype)


def joined(column: pa.ChunkedArray, dtype, read=unpack) -> np.ndarray:
    """All arrays of a binary column, one after the other."""
    parts = [read(x.as_buffer(), dtype) for chunk in column.chunks for x in chunk]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: numpy's own way builds a hash table, which is slower here."""
    values = np.sort(values)
    return values[runs(values)]


def range_bits(docs: DataFrame, each: int, least: int = 3) -> int:
    """log2 of the number of hash ranges at which a range holds about `each` characters' worth of keys."""
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return min(30, max(least, int(np.ceil(np.log2(max(1, chars / each))))))


def by_range(hashes: np.ndarray, bits: int):
    """The ranges that sorted hashes lie in, and where each begins and ends: no more than there are hashes."""
    part = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    lo = runs(part)
    return zip(part[lo].tolist(), lo.tolist(), [*lo[1:].tolist(), len(part)])


def rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema)], schema=schema)
