"""Document fingerprints: one-permutation MinHash with optimal densification and low-order bits."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm._base import mix, read, shingle_hashes, slices, text_of

BINS = 512
BITS = 4  # of each bin's value: one hexadecimal digit
NONE = np.uint64(2**64 - 1)
_SHIFT = np.uint64(64 - 9)
_PROBES: list[np.ndarray] = []


def probes() -> np.ndarray:
    """For each bin the order in which it looks for a filled one: a permutation of all bins."""
    if not _PROBES:
        n = np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS)
        _PROBES.append(mix(n + np.uint64(0x51ED270B)).argsort(axis=1, kind="stable").astype(np.uint16))
    return _PROBES[0]


def minima(texts: list[bytes]) -> np.ndarray:
    """The smallest shingle hash of each bin, one row a text; empty bins hold NONE."""
    h, at = shingle_hashes(texts)
    out = np.full(len(texts) * BINS, NONE, dtype=np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    np.minimum.at(out, doc * BINS + (h >> _SHIFT).astype(np.int64), h)
    return out.reshape(-1, BINS)


def densify(rows: np.ndarray) -> np.ndarray:
    """Fill each empty bin from the first filled bin of its probe order; rows without any stay empty."""
    filled = rows != NONE
    r, c = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    order = probes()
    for t in range(BINS):
        if not len(r):
            break
        at = order[c, t].astype(np.int64)
        ok = filled[r, at]
        rows[r[ok], c[ok]] = rows[r[ok], at[ok]]
        r, c = r[~ok], c[~ok]
    return rows


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of each bin (one row a text), and which texts have any shingle."""
    rows = densify(minima(texts))
    return (rows & np.uint64(2**BITS - 1)).astype(np.uint8), rows[:, 0] != NONE


def spelled(bits: np.ndarray, some: np.ndarray) -> list[str]:
    """Hexadecimal digits, one a bin; an empty string for a text without shingles."""
    packed = (bits[:, 0::2] << 4) | bits[:, 1::2]
    return [x.tobytes().hex() if s else "" for x, s in zip(packed, some, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: the share of equal bins without that of chance; 1 for two empty texts."""
    chance = 0.5**BITS
    est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, est, np.where(some_a | some_b, 0.0, 1.0))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each document, without any shuffle. Null and empty texts have an empty one."""

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            out: list[str] = []
            for i, j in _chunks(texts):
                out += spelled(*fingerprints(texts[i:j]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return text_of(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _chunks(texts: list[bytes]):
    for i, j in slices(texts):
        for k in range(i, j, 1000):
            yield k, min(k + 1000, j)


# --- neighbours in the order of doc_id

OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(cell: list[tuple[int | None, str]]):
    """Results of all rows of a run but the last, which only follows."""
    texts = [t for _, t in cell]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:], strict=False)]
    raw, new = [t.encode() for t in texts], [t.encode() for t in edited]
    both = raw + new
    parts = [fingerprints(both[i:j]) for i, j in _chunks(both)]
    bits, some = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    n = len(edited)
    own, nxt, edit = slice(0, n), slice(1, n + 1), slice(n + 1, 2 * n + 1)
    words = spelled(bits, some)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in cell[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in new], pa.string()),
            pa.array(words[own], pa.string()), pa.array(words[edit], pa.string()),
            pa.array(likeness(bits[own], bits[edit], some[own], some[edit]), pa.float64()), pa.array(likeness(bits[own], bits[nxt], some[own], some[nxt]), pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _run(batches):
    """Rows sorted by (cell, guard, descending key): each is paired with the one after it in its cell."""
    held: list[tuple[int | None, str]] = []
    size, cell, closed = 0, None, False
    for b in batches:
        for c, g, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if c != cell:
                cell, held, size, closed = c, [], 0, False
            if closed:
                continue
            held.append((doc, text))
            size += len(text)
            if g or size > 4_000_000 or len(held) > 1000:
                if len(held) > 1:
                    yield _pairs(held)
                held, size, closed = held[-1:], len(text), bool(g)
    # every cell ends in a guard row, so nothing is held back here


def cell_of(key: str, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not above the key: a binary search without Python, so that no worker runs and no texts wait while they are dealt."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= F.col(key)), at + step).otherwise(at),
    )


def neighbours(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    The next document is that of the next smaller doc_id, after the smallest
    that of the largest (a lone document follows itself). Rows that repeat a
    doc_id follow each other by a hash of the text; a null doc_id comes last.
    Null and empty texts have an empty fingerprint, which is like an empty one
    (1) and unlike all others (0). An empty table gives no rows; other columns
    are ignored.

    Documents are cut into cells of the doc_id order; the first rows of the
    next cell are sent along as guards, so a cell is worked through alone, in
    one pass, after one shuffle.
    """
    spark = docs.sparkSession
    rows = text_of(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("tie", F.xxhash64("text"))
    n = cells or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    cut = rows.agg(F.percentile_approx("key", shares, 20 * n).alias("c")).first()["c"] if n > 1 else []
    cuts = sorted(set(cut or []))

    # one number for each cell, at most n of them
    heads = sorted((r["cell"], r["key"]) for r in rows.select("key").withColumn("cell", cell_of("key", cuts)).groupBy("cell").agg(F.max("key").alias("key")).collect())
    guards = [(heads[i - 1][1], heads[i][0]) for i in range(1, len(heads))] + ([(heads[-1][1], heads[0][0])] if heads else [])
    guard = spark.createDataFrame(guards, "key long, cell int").groupBy("key").agg(F.collect_list("cell").alias("ahead"))
    dealt = (
        rows.join(F.broadcast(guard), "key", "left")
        .withColumn("at", F.explode(F.concat(F.array(F.struct(cell_of("key", cuts).alias("cell"), F.lit(0).alias("guard"))), F.transform(F.coalesce("ahead", F.array().cast("array<int>")), lambda c: F.struct(c.alias("cell"), F.lit(1).alias("guard"))))))
        .select("at.cell", "at.guard", "doc_id", "text", "key", "tie")
    )
    # the first of several rows of one doc_id is the guard: all of them are sent, the hash orders them
    return dealt.repartition(n, "cell").sortWithinPartitions("cell", "guard", F.desc("key"), "tie").select("cell", "guard", "doc_id", "text").mapInArrow(_run, OUT)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "documents"))
