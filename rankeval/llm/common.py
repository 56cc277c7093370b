"""Shared parts of the training-data operators: table access, staging and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rankeval.session import ship

#: Bytes of text that the numpy kernels take at a time; a longer document is taken whole, alone.
CHUNK_BYTES = 1 << 19
#: A key is hot if more than one of so many rows has it; fewer than this many can be, so these may be broadcast.
HOT_SHARE = 2000

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = _U64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow() on executors that have this package."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # the others keep what they free, beside what the process itself keeps
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return to the system what a task has freed: its worker lives on, idle, through the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_folders: dict[str, str] = {}
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; where that is unset, a temporary one in local mode, else an error."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="rankeval-")
        _folders[app] = f"{root.rstrip('/')}/rankeval-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # the JVM may be gone by now
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, so a lost executor costs no earlier stage.

    The shuffle files behind it are let go (Spark drops them when the driver's JVM collects its garbage).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows, staged; all that it had staged itself is deleted."""
    mark = len(_written)
    out = staged(df := make(), name)
    for path in _written[mark:-1]:
        _delete(df.sparkSession, path)
    del _written[mark:-1]
    return out


def unstage(df: DataFrame) -> None:
    """Delete what staged() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for file in df.inputFiles()[:1]:
        parent = file.rpartition("/")[0]
        if folder.rpartition("/")[2] in parent:
            _delete(spark, parent)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    binary = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    return [x or b"" for x in binary.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 8 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about limit bytes, so that copies of a slice stay small; a longer row is a slice."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together; every text is in one range, whole."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def byte_class(chars: bytes, above: bool) -> np.ndarray:
    """A table of the bytes that words consist of: those given and, with above, all of 0x80 and up."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    out[128:] = above
    return out


#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_class(bytes(b for b in range(128) if b != 0x20 and not 0x09 <= b <= 0x0D), True)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
ALNUM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz", True)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(27)
    h *= _U64(0x94D049BB133111EB)
    h ^= h >> _U64(31)
    return h


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U64)
    out[0] = 1
    return np.cumprod(out, dtype=_U64)


_BYTE = mixed(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
_held: list[np.ndarray] = [np.zeros(0, _U64), np.zeros(0, _U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2^64, kept from call to call up to two chunks."""
    if len(_held[0]) >= n:
        return _held[0][:n], _held[1][:n]
    both = _powers(n, _BASE), _powers(n, _BASE_INV)
    if n <= 2 * CHUNK_BYTES:
        _held[:] = both
    return both


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash() takes the hash of any range of buf."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, _U64)
    np.cumsum(_BYTE[buf] * up[:-1], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes starts..ends, the same wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


class Words:
    """The words of some texts, as hashes. doc: each word's text; first: each text's first word, and the end."""

    def __init__(self, texts: list[bytes], of: np.ndarray):
        blob = b"\n".join(texts).lower()  # bytes.lower() lower-cases A-Z alone
        self.buf = np.frombuffer(blob, np.uint8)
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = of[self.buf]
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = range_hash(prefix_hash(self.buf), self.starts, self.ends) if len(self.starts) else np.zeros(0, _U64)
        self.blob = blob

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of k words within a text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U64)
        acc = np.zeros(n, _U64)
        for j in range(k):
            acc *= _STEP
            acc += self.hash[j : n + j]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mixed(acc[at] ^ _U64(k))

    def text(self, a: int, b: int) -> list[bytes]:
        return [self.blob[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]
