"""Helpers shared by the operators: shared-folder tables, texts as byte buffers, word hashes."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slimwire.session import checkpoint_dir

# The white space of every contract here, and what is not white space.
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_WINDOW = 1 << 20  # bytes hashed at a time
_SLICE = 1 << 21   # bytes of text handled at a time, more only for one longer text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    for made in _scratch[-1:]:
        made.append(path)
    return path


_scratch: list[list[str]] = []  # paths made in the scopes that are open


@contextmanager
def scratch(spark: SparkSession, before: Sequence[str] = ()) -> Iterator[list[str]]:
    """A scope whose last written table stays: the paths made within before it, and those of ``before``, are removed at its end.

    For steps whose last act is to write their whole result. Yields the paths; after the end, the one that stays. After
    an error nothing is removed."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.pop()
    for path in [*before, *made[:-1]]:
        removed(spark, path)
    del made[:-1]


def removed(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL = 100_000  # rows up to which a table is broadcast; beyond that a join is left to Spark


def sent(rows: DataFrame) -> DataFrame:
    """``rows``, marked to be broadcast where they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def numbered(df: DataFrame, order: list[Column | str], name: str, column: str = "__at") -> DataFrame:
    """``df`` with ``column``: each row's position in ``order``, without gaps, from 0. Equal rows stand in any order.

    Ranges of the order are the partitions of a written table; only a count a partition is sent round. The last
    key of a range is the row's place in the input, so that equal rows are split as well."""
    spark = df.sparkSession
    key = "__place"
    placed = df.withColumn(key, F.monotonically_increasing_id())
    ranges = placed.repartitionByRange(shuffle_partitions(spark), *order, key).sortWithinPartitions(*order, key).drop(key)
    held = written(ranges.withColumn("__range", F.spark_partition_id())
                   .withColumn("__within", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    before, total = [], 0
    for r in held.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():  # one row a partition
        before.append((r["__range"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(before, "__range int, __before long"))
    return held.join(starts, "__range").withColumn(column, F.col("__before") + F.col("__within")).drop("__range", "__before", "__within")


#: Bytes of an Arrow batch that goes to Python: rows are whole texts, so a bound on rows alone bounds nothing.
BATCH_BYTES = 4 << 20


def _free_unused() -> None:
    """Give memory that the process holds but doesn't use back to the machine: idle Python workers stay beside busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of about BATCH_BYTES (a longer row is a batch of its own); a task's worker
    frees what it doesn't use when the task ends.

    Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` in the session."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _free_unused()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def mounted(path: str) -> str:
    """The file-system path of a shared folder that workers map into memory.

    Raises ValueError for a store without a mount (hdfs, s3): memory mapping needs one.
    """
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        if scheme != "file":
            raise ValueError(f"memory-mapped models need a mounted shared folder, not {path!r}; "
                             "set spark.checkpoint.dir to a file: path that all executors mount")
        return "/" + rest.lstrip("/")
    return os.path.abspath(path)


def crc_mod(column: str | Column, n: int) -> Column:
    """crc32 of the value as text, mod n; a null counts as empty text (0)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string")) % n, F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- texts as byte buffers -------------------------------------------------------------

def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def slices(offsets: np.ndarray, size: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about ``size`` bytes; every text whole, so one longer text is a run."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Bytes between bare words: all of ASCII but letters and digits.
BARE = np.zeros(256, bool)
BARE[:128] = True
BARE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, runs of bytes not in ``space``: byte starts, byte ends, and for each text the index of its first word."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    edge = np.empty(len(data) + 1, bool)  # a text's first byte begins anew
    edge[:-1] = False
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mix(a * _U(0x9E3779B97F4A7C15) + b * _U(0xC2B2AE3D27D4EB4F) + _U(0x165667B19E3779F9))


_BYTE = mix(np.arange(1, 257, dtype=_U))                 # a value per byte, A-Z as a-z
_BYTE[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15                                   # odd, so it has an inverse
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, _WINDOW + 1), base, _U)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=_U)
    return _powers[base]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z as a-z: a rolling polynomial over the buffer, window by window."""
    out = np.empty(len(starts), _U)
    i, n = 0, len(starts)
    while i < n:
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _WINDOW, "right")))
        size = int(ends[j - 1] - base)
        run = np.zeros(size + 1, _U)
        np.cumsum(_BYTE[data[base:base + size]] * _power(_P, size)[:size], dtype=_U, out=run[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (run[e] - run[s]) * _power(pow(_P, -1, 1 << 64), size)[s]
        i = j
    return mix(out ^ (ends - starts).astype(_U) * _U(_P))


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and for each text the index of its first word."""
    starts, ends, first = spans(data, offsets, space)
    return span_hashes(data, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words (with fewer words, the whole sequence; without words, none).

    Returns the hashes in text order, and for each text the index of its first one.
    """
    counts = np.diff(first)
    n = len(words)
    h = words.copy()
    for j in range(1, k):
        h[:n - j] = pair(h[:n - j], words[j:])
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(first[:-1] - out[:-1], many) + np.arange(out[-1])
    got = h[at]
    for i in np.flatnonzero((counts > 0) & (counts < k)):  # a short text: its own words alone
        g = words[first[i]:first[i] + 1].copy()
        for j in range(1, int(counts[i])):
            g = pair(g, words[first[i] + j:first[i] + j + 1])
        got[out[i]] = pair(g, np.array([counts[i]], _U))[0]
    return got, out
