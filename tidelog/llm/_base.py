"""Shared plumbing: reading tables, shared scratch tables and hashing of words.

Intermediate results are Parquet tables below ``spark.checkpoint.dir`` (a
folder that driver and executors share), so a lost executor never loses them.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import scratch, ship

#: Bytes of rows that go to a Python worker at once; a single longer row goes alone.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return frugal(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def frugal(spark: SparkSession) -> SparkSession:
    """Bound what a Python worker gets at once by bytes, as texts may be very long; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key)
    if not have[:-1].isdigit() or have[-1] not in "b0123456789" or int(have.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    return ship(spark)


def shielded(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1 ... so that no name of theirs can clash with one of an operator."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores after it as it takes to differ from all names in ``taken``, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared scratch table and read it back (cuts lineage)."""
    spark = frugal(df.sparkSession)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labels(spark: SparkSession, n: int) -> list[int]:
    """One integer for each of n partitions that hash partitioning sends there, so that n cells fill n partitions evenly."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = {r["p"]: r["id"] for r in spark.range(24 * n + 64).groupBy(at.alias("p")).agg(F.min("id").alias("id")).collect()}  # n rows
    return [found.get(i, i) for i in range(n)]


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now rather than when the driver's heap fills, and executors
    return the heap that these steps needed, which they otherwise keep at its largest size.

    The executors' part comes first: the driver holds the last plan, and so its shuffle files, until another has run.
    """
    n = spark.sparkContext.defaultParallelism  # a task for each core, so that every executor has one
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what this Python worker has freed to the system, where its C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def lean(run):
    """``run``, a function of batches, that gives memory back at the end of each task: workers stay for later tasks, and idle ones count as well."""

    def inner(batches):
        yield from run(batches)
        give_back()

    return inner


def text_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


# --- vectorised hashing of words -------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240117))
BYTE_CODE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C13 | 3)
_INV = np.uint64(pow(int(BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POW: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, kept for later batches."""
    key = "inv" if inverse else "pow"
    have = _POW.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, _INV if inverse else BASE, dtype=np.uint64)
        out[0] = 1
        _POW[key] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and for each text where its words begin.

    Words are runs of bytes other than white space, with A-Z lower-cased.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    data = LOWER[data]
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=sums[1:])
    h = (sums[end] - sums[begin]) * powers(len(data), inverse=True)[begin]
    h = mix(h + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    return h, np.searchsorted(begin, starts)


_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles in order (not distinct), and for each text its bounds.

    A text with fewer words than ``width`` has its whole word sequence as one
    shingle; a text without words has none.
    """
    h, at = word_hashes(texts)
    n = np.diff(at)
    if not len(h):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    acc = h.copy()
    for j in range(1, min(width, len(h))):
        acc[: len(h) - j] = acc[: len(h) - j] * _STEP + h[j:]
    doc = np.repeat(np.arange(len(texts)), n)
    full = np.arange(len(h)) + width <= at[1:][doc]
    for i in np.flatnonzero((n > 0) & (n < width)):
        x = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in h[at[i] : at[i + 1]]:
                x = x * _STEP + w
        acc[at[i]] = x + np.uint64(n[i])
        full[at[i]] = True
    out = mix(acc[full])
    return out, np.concatenate(([0], np.cumsum(np.where(n >= width, n - width + 1, n > 0))))


def slices(texts: list[bytes], limit: int = 1 << 19):
    """(first, last) ranges of texts of about ``limit`` bytes together; a longer text stands alone. Hashing takes many times their bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def binary_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
