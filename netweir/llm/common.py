"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import inspect
import math
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
#: Bytes and rows of an Arrow batch between Spark and its Python workers.
ARROW_BYTES, ARROW_ROWS = 4 << 20, 4000
#: Bits of a hash that pack() keeps.
KEY_BITS = 48


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A local session without that setting, as in tests, gets a fresh folder of its own; on a cluster, where a folder of one
    machine would lose data silently, the setting must be there.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not given and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return given or sc.getCheckpointDir()


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that batches of long texts stay small; settings that are smaller already stay."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give memory that is free again back to the system: workers live on between tasks, and idle ones keep theirs else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not on this platform
        pass


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that releases memory when its task's batches are through."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def grouped_tidy(fn: Callable) -> Callable:
    """A function of one table, or of two, for applyInArrow that releases memory after each group."""

    def tidied(*tables: pa.Table) -> pa.Table:
        try:
            return fn(*tables)
        finally:
            release()

    two = len(inspect.signature(fn).parameters) == 2
    return (lambda a, b: tidied(a, b)) if two else lambda a: tidied(a)  # Spark looks at how many parameters there are


def cut(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder and continue from there, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = 2000) -> DataFrame:
    """mapInArrow over pieces of at most ``most`` rows; fn gets and returns record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, most):
                if (out := fn(b.slice(i, most))) is not None:
                    yield out

    bounded(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def pieces(total: int, each: int = BATCH_BYTES) -> int:
    """How many pieces of about ``each`` bytes hold ``total`` bytes."""
    return max(1, math.ceil(total / each))


def parts(spark: SparkSession, total: int, each: int = 2 * BATCH_BYTES) -> int:
    """Shuffle partitions for ``total`` bytes: the session's number or what keeps a partition near ``each`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces(total, each))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit (the public murmur3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pack(keys: np.ndarray) -> bytes:
    """Sorted 48-bit numbers: differences, byte by byte, compressed."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
    return len(keys).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(step.T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    if not n:
        return np.zeros(0, np.uint64)
    step = np.zeros((n, 8), np.uint8)
    step[:, : KEY_BITS // 8] = np.frombuffer(pa.decompress(data[4:], n * KEY_BITS // 8, codec="zstd"), np.uint8).reshape(-1, n).T
    return np.cumsum(step.view("<u8").reshape(-1), dtype=np.uint64)


def zipped(x: np.ndarray) -> bytes:
    return len(x.tobytes()).to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def unzipped(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"), kind)
