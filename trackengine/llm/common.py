"""What the corpus operators share: table access, shared work tables, bounded Arrow batches, vectorised words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: narrow rows come by thousands, long texts by a few.
BATCH_ROWS, BATCH_BYTES = 8192, 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too where the session still has Spark's defaults, which bound them by rows alone."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows)) >= 10_000:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not spark.conf.get(size, None):
        spark.conf.set(size, str(BATCH_BYTES))


def give_back() -> None:
    """Return what a worker's allocators hold unused to the system; where the C library has no malloc_trim, Arrow's alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function over batches whose worker gives unused memory back behind the last one. Workers serve one stage after
    the other, and what the largest batch of each needed would stay with them."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


_OWN: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one gets a temporary one.

    On a cluster there is no such folder to fall back to, so an unset spark.checkpoint.dir is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="trackengine-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        base = f"file://{_OWN[app]}"
    return base


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and nothing before it is computed twice."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/trackengine/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete work tables that nothing will read again, and let Spark drop the shuffle files behind them."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.work_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Shuffle files go once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in range(1, len(taken) + 2) if (n := "_" * k + name) not in taken) for name in names]


#: Rows of a few numbers that are broadcast at most; a hashed row takes about 70 bytes of each executor.
BROADCAST_ROWS = 1 << 19


def checked(df: DataFrame) -> DataFrame:
    """A work table of a few numbers a row, to be broadcast if it has BROADCAST_ROWS rows at most; else Spark shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of an id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m


def text_bytes(col: str = "text") -> Column:
    """A text as UTF-8, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


# Vectorised words -----------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WMULT = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, kept as far as were asked for, up to KEEP."""

    KEEP = 1 << 20

    def __init__(self, base: np.uint64):
        inv = pow(int(base), -1, 2**64)
        self.bases, self.tables = (base, np.uint64(inv)), [np.ones(1, np.uint64)] * 2

    def __call__(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) >= n:
            return self.tables
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n <= self.KEEP else n
        with np.errstate(over="ignore"):
            tables = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in self.bases]
        if n <= self.KEEP:
            self.tables = tables
        return tables


_BYTES, _WORDS = _Powers(_MULT), _Powers(_WMULT)


def mix(h: np.ndarray) -> np.ndarray:
    """Final scrambling of 64-bit hashes (the multiply-xorshift of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words of a UTF-8 buffer begin and end; words are runs without ASCII white space."""
    inside = np.concatenate([[False], ~_SPACE[buf], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of byte values times powers of an odd number."""
    up, down = _BYTES(len(buf) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)])])
        return mix((prefix[end] - prefix[start]) * down[start])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by the same prefix sums."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _WORDS(n + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n])])
        return mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of words from start to end, as window_hashes() gives it."""
    up, down = _WORDS(len(words) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
        return mix((prefix[end] - prefix[start]) * down[start])


def sliding(values: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every w neighbours, by doubling."""
    if len(values) < w:
        return values[:0]
    out, size = values, 1
    while size * 2 <= w:
        out, size = pick(out[:-size], out[size:]), size * 2
    return out if size == w else pick(out[: len(values) - w + 1], out[w - size : w - size + len(values) - w + 1])
