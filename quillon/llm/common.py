"""Shared helpers: Arrow text buffers, vectorised word hashing, checkpoints.

Texts reach Python as Arrow buffers. Work is done on slices of a bounded
number of bytes (at least one document), so memory doesn't follow the size
of a partition.
"""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 512 << 10
#: Bytes of an Arrow batch on its way to Python; Spark's own bound is eight times that, for each of an executor's workers.
BATCH_BYTES = 8 << 20
WHITE = (0x20, *range(0x09, 0x0E))
WORD = r"[^\x20\x09-\x0D]+"

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def bound_batches(spark: SparkSession) -> None:
    """Lowers Spark's bound of an Arrow batch's bytes, where the session hasn't a lower one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.match(r"(-?\d+)([kmgtp]?)", spark.conf.get(name, f"{1 << 26}b").lower()).groups()
    have = int(size) << 10 * " kmgtp".index(unit or " ")
    if not 0 < have <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, one of this machine for a local session only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: tables between phases need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, **counts: Column) -> DataFrame:
    """df from a table written to the shared folder of spark.checkpoint.dir (one is set only where none is).

    That ends the lineage for executors that are lost, and for the optimizer:
    a checkpointed frame would keep the orderings of all the joins it came of,
    which grow without bound over rounds. How many rows it has, and further
    aggregates, are counted on the way (see counted()).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in counts.items())).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path, out._quillon_counts = path, seen.get
    _written[path] = spark
    return out


def counted(df: DataFrame, name: str = "rows") -> int:
    """A count of a frame that cut() made; rows of any other are counted by a job."""
    have = getattr(df, "_quillon_counts", None)
    return have[name] if have is not None else df.count()


def free(*frames: DataFrame) -> None:
    """Deletes the tables of frames that cut() made, when nothing that is still to run reads them."""
    for df in frames:
        path = getattr(df, "_quillon_path", None)
        if path and _written.pop(path, None):
            sc = df.sparkSession.sparkContext
            name = sc._jvm.org.apache.hadoop.fs.Path(path)
            name.getFileSystem(sc._jsc.hadoopConfiguration()).delete(name, True)


def written() -> set[str]:
    """The tables of cut() that are still there."""
    return set(_written)


def free_since(spark: SparkSession, before: set[str], *keep: DataFrame) -> None:
    """Deletes the tables that cut() has made since written() was `before`, but for those of keep."""
    kept = {getattr(df, "_quillon_path", None) for df in keep}
    for path in written() - before - kept:
        frame = spark.range(0)
        frame._quillon_path = path
        free(frame)


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished phases (it does when their frames are collected as garbage), and gives memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n. Only those of a slice are kept: longer texts' go with them."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size == SLICE_BYTES + 65536:
            _POWERS[0] = have
    return have


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums for span_hash()."""
    up, _ = powers(len(values) + 1)
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal runs wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def each_slice(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(text))
        for i, j in slices(offsets, limit):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def append_columns(df: DataFrame, text: str, fn: Callable, extra: list[T.StructField], limit: int = SLICE_BYTES) -> DataFrame:
    """df with columns that fn(bytes, offsets) -> list of Arrow arrays makes from each slice of texts."""
    schema = T.StructType([*df.schema.fields, *extra])

    def run(batches):
        for batch, data, offsets in each_slice(batches, text, limit):
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(data, offsets)], names=schema.names)

    return df.mapInArrow(run, schema)


def lookup(white: tuple[int, ...] | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased byte and word flag of each byte; without white space given, words are letters, digits and what isn't ASCII."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, dtype=bool)
    if white is None:
        word[48:58] = word[97:123] = word[65:91] = word[128:] = True
    else:
        word[:] = True
        word[list(white)] = False
    return low, word


def words_of(data: np.ndarray, offsets: np.ndarray, low: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; start, end and document of each word. Words end with their document."""
    lowered, flag = low[data], word[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return lowered, none, none, none
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start, end = flag.copy(), flag.copy()
    start[1:] &= ~flag[:-1]
    end[:-1] &= ~flag[1:]
    start[inner], end[inner - 1] = flag[inner], flag[inner - 1]
    s = np.flatnonzero(start)
    return lowered, s, np.flatnonzero(end) + 1, np.searchsorted(offsets, s, side="right") - 1


def word_hashes(lowered: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(rolling(BYTE_CODE[lowered]), start, end)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counts no further than that, and a table of cut() not again."""
    return counted(df) <= rows if hasattr(df, "_quillon_counts") else df.limit(rows + 1).count() <= rows


#: Narrow rows (ids and hashes) up to which a side of a join is broadcast.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, within: DataFrame | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for a broadcast if it is small(), or `within`, which has at least its rows; beyond that the join shuffles."""
    return F.broadcast(df) if (within is not None and small(within, rows)) or small(df, rows) else df


def labelled(docs: DataFrame, labels: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join by doc_id. labels (one row a doc_id) are broadcast up to that many rows, joined by a shuffle beyond it."""
    return docs.join(sized(labels, rows=broadcast_rows), "doc_id")


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)


def guarded(docs: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all but the columns to keep renamed, so that no name clashes with an operator's own; and what takes a frame back to docs' columns."""
    names = docs.columns
    inner = [c if c in keep else f"c{i}" for i, c in enumerate(names)]
    return docs.toDF(*inner), lambda out: out.select(*inner).toDF(*names)
