"""Byte functions that Spark has no built-in for, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
CRC32C_POLYNOMIAL = 0x82F63B78


def _matrix(keys) -> tuple[np.ndarray, np.ndarray]:
    raw = [k.encode() if isinstance(k, str) else bytes(k or b"") for k in keys]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    out = np.zeros((len(raw), int(size.max(initial=0))), dtype=np.uint8)
    for i, r in enumerate(raw):
        out[i, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    return out, size


def fnv1a(keys) -> np.ndarray:
    """64-bit FNV-1a of each key."""
    rows, size = _matrix(keys)
    h = np.full(len(rows), FNV_OFFSET, dtype=np.uint64)
    for j in range(rows.shape[1]):
        h = np.where(j < size, (h ^ rows[:, j]) * np.uint64(FNV_PRIME), h)
    return h


def _crc32c_of_byte(c: int) -> int:
    for _ in range(8):
        c = (c >> 1) ^ (CRC32C_POLYNOMIAL if c & 1 else 0)
    return c


_CRC32C = [_crc32c_of_byte(i) for i in range(256)]


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC32C[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def fnv1a64(key) -> Column:
    """The hash as a signed long."""

    def run(key: pd.Series) -> pd.Series:
        return pd.Series(fnv1a(key).view(np.int64))

    return F.pandas_udf(run, "long")(key)


def crc32c_of(data) -> Column:
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([crc32c(d.encode() if isinstance(d, str) else bytes(d or b"")) for d in data], dtype="int64")

    return F.pandas_udf(run, "long")(data)


def next_power_of_two(n: int) -> int:
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def common_prefix(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def shared_prefix(a, b) -> Column:
    """Bytes that two strings or binaries have in common at their beginning; none with a null."""
    x, y = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("binary") for c in (a, b))
    n = F.least(F.octet_length(x), F.octet_length(y))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i))
    return F.when(n > 0, F.size(same)).otherwise(0).cast("long")


def hash_shard(key, shards: int):
    """The in-memory shard of a key: the low bits of its hash, for a power of two of shards."""
    return fnv1a64(key).bitwiseAND(F.lit(next_power_of_two(shards) - 1))


class Bloom:
    """A Bloom filter over keys: two halves of one hash give all probes."""

    def __init__(self, n: int, bits_per_key: int):
        self.m = max(64, n * bits_per_key)
        self.k = min(30, max(1, int(bits_per_key * 0.69)))
        self.bits = np.zeros(self.m, dtype=bool)

    def _places(self, keys) -> np.ndarray:
        h = fnv1a(keys)
        step = (h >> np.uint64(33)) | np.uint64(1)
        return np.stack([(h + np.uint64(i) * step) % np.uint64(self.m) for i in range(self.k)], axis=1)

    def add(self, keys) -> None:
        self.bits[self._places(keys).ravel().astype(np.int64)] = True

    def might_hold(self, keys) -> np.ndarray:
        return self.bits[self._places(keys).astype(np.int64)].all(axis=1)
