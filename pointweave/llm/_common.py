"""Helpers shared by the corpus operators: reading, Arrow batches, hashes and lineage cuts."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks: the words of every contract are the runs of other characters.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
#: Bytes that are looked at together.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df of a file scan, dealt to all cores where its splits are fewer; larger inputs are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def session(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows and bytes, so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset the warehouse, which a cluster shares too, or on a local master a temporary folder."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir", None):
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="checkpoint-")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder that all executors share, and reads it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(n: int):
    """crc32 of the decimal doc_id, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run; after a task's last batch the worker, which later tasks use again, gives memory that was freed back to the system."""

    def through(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return through


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n, buffers = len(column), column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and n else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser, element by element."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_BYTE = seeded(256, 77) | U64(1)
_R = U64(0x9E6C63D0676A9A99)
_RINV = U64(pow(int(_R), -1, 1 << 64))


def _powers(n: int, _kept: list = [np.ones(1, U64), np.ones(1, U64)]) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(_kept[0]) < n:
        with np.errstate(over="ignore"):
            for i, r in enumerate((_R, _RINV)):
                x = np.full(max(n, 1 << 16), r, U64)
                x[0] = 1
                _kept[i] = np.cumprod(x, dtype=U64)
    return _kept[0], _kept[1]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of documents that lie end to end: their 64-bit hashes, first bytes and ends, and the n + 1 word offsets."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    blank = np.zeros(256, bool)
    blank[list(BLANKS)] = True
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a = 0
    while a < len(data):
        z = _stop(data, offsets, blank, a + SLICE) if a + SLICE < len(data) else len(data)
        edges = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, z, side="right")] - a
        found.append(tuple(x + s for x, s in zip(_words_in(data[a:z], edges, blank), (U64(0), a, a), strict=True)))
        a = z
    hashes, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, begin, end, np.searchsorted(begin, offsets)


def _stop(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray, z: int) -> int:
    """The first place from z on where no word is cut: a blank or a document's end."""
    limit = int(offsets[np.searchsorted(offsets, z)])
    while z < limit:
        here = np.flatnonzero(blank[data[z : min(z + 4096, limit)]])
        if len(here):
            return z + int(here[0])
        z = min(z + 4096, limit)
    return limit


def _words_in(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the words of data; no word reaches over one of offsets."""
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        return mix64((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U64)), begin, end


def chunks_of(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows with about `size` bytes; a longer text makes a run alone."""
    data, offsets = bytes_of(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
