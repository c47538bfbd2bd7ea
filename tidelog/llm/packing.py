"""Harmonic packing of token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm._base import lean, materialize, read, text_of

CAPACITY = 2048
END_ID = 1
#: A rest of fewer tokens is not cut again: what its sequences lack is a small share of them.
SMALLEST = 128

PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, class int, bin long, offset long, nth long"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of n tokens, in order.

    Whole sequences first. A rest of class k (k of its length fit a sequence,
    but not k + 1) stays whole where it nearly fills its place of capacity / k
    tokens, or is short; else the largest place of the next class is cut from
    it, which leaves less than a k-th of it.
    """
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        k = capacity // rest
        size = rest if rest < smallest or 32 * rest >= 31 * (capacity // k) else capacity // (k + 1)
        out.append(size)
        rest -= size
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, checksums: bool = False) -> DataFrame:
    """Pieces of every document's tokens, closed by ``end_id``, in the bins of their classes.

    A piece of class k shares a bin with k - 1 others; each task fills bins on
    its own. ``bin`` and ``offset`` are null for the pieces of a task's last,
    incomplete bin of a class, of which ``nth`` counts the pieces. ``ids`` are
    little-endian unsigned 32-bit integers, or their CRC-32 in as many bytes.
    A task holds at most one open bin of each class, of which there are about
    twice the root of the capacity.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
        ("part", pa.int32()), ("class", pa.int32()), ("bin", pa.int64()), ("offset", pa.int64()), ("nth", pa.int64()),
    ])
    end = int(end_id).to_bytes(4, "little")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches):
        from tidelog.llm import _words

        encode = _words.shared(tokenizer).ids
        part, filled = TaskContext.get().partitionId(), 0
        opened: dict[int, list[tuple]] = defaultdict(list)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n, at = len(ids) // 4, 0
                for size in cuts(n, capacity):
                    own, k = ids[4 * at : 4 * (at + size)], capacity // size
                    mates = opened[k]
                    mates.append((doc, at, size, n, zlib.crc32(own).to_bytes(4, "little") if checksums else own))
                    if len(mates) == k:
                        offset = 0
                        for p in mates:
                            rows.append((*p, part, k, filled, offset, None))
                            offset += p[2]
                        filled += 1
                        del opened[k]
                    at += size
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)
        yield batch([(*p, part, k, None, None, i) for k, mates in sorted(opened.items()) for i, p in enumerate(mates)])

    return text_of(docs).mapInArrow(lean(run), PIECE)


def _fit(capacity: int):
    """The last pieces of all classes to common sequences: by falling length, each where it leaves the least room."""

    def run(table: pa.Table) -> pa.Table:
        length, doc, start = (table.column(c).to_pylist() for c in ("length", "doc_id", "start"))
        room: list[tuple[int, int]] = []  # of each sequence, ascending, with its number
        at, offset, made = [0] * len(length), [0] * len(length), 0
        for i in sorted(range(len(length)), key=lambda i: (-length[i], doc[i] is None, doc[i] or 0, start[i])):
            k = bisect_left(room, (length[i], -1))
            left, number = room.pop(k) if k < len(room) else (capacity, made)
            made = max(made, number + 1)
            at[i], offset[i] = number, capacity - left
            if left > length[i]:
                insort(room, (left - length[i], number))
        return table.append_column("at", pa.array(at, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset in place of part, class, bin and nth.

    A bin that a task has filled is a sequence. What tasks leave open of a
    class is numbered on, task after task, from counts with one row a task and class,
    and every k of it make a sequence. At the end fewer than k pieces of each
    class are left, some thousands in all whatever the input (fewer than the
    capacity times the logarithm of it); these share sequences.
    """
    placed = materialize(pieces, "pieces")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy("part").agg((F.coalesce(F.max("bin"), F.lit(-1)) + 1).alias("bins"))
    tasks = tasks.select("part", F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("first"), F.sum("bins").over(Window.partitionBy()).alias("all_bins"))  # one row a task
    rest = placed.filter("bin IS NULL")
    counts = rest.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = F.floor(F.sum("n") / F.first("class"))
    classes = counts.groupBy("class").agg(whole.alias("whole"))  # about 90 at a capacity of 2048
    classes = classes.select("class", "whole", F.coalesce(F.sum("whole").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("whole").over(Window.partitionBy()).alias("wholes"))
    keep = [c for c in placed.columns if c not in ("part", "class", "bin", "offset", "nth")]
    full = placed.filter("bin IS NOT NULL").join(tasks, "part").select(*keep, (F.col("first") + F.col("bin")).cast("long").alias("sequence_id"), "offset")
    total = tasks.agg(F.max("all_bins").alias("all_bins"))  # one row
    left = rest.join(counts.join(F.broadcast(classes), "class").drop("n"), ["part", "class"]).crossJoin(F.broadcast(total))
    left = left.withColumn("place", F.col("before") + F.col("nth"))
    full_left = left.filter(F.col("place") < F.col("whole") * F.col("class"))
    full_left = full_left.withColumn("sequence_id", (F.col("all_bins") + F.col("base") + F.floor(F.col("place") / F.col("class"))).cast("long"))
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    full_left = full_left.select(*keep, "sequence_id", F.coalesce(ahead, F.lit(0)).cast("long").alias("offset"))
    last = left.filter(F.col("place") >= F.col("whole") * F.col("class")).select(*keep, (F.col("all_bins") + F.col("wholes")).cast("long").alias("from"), F.lit(0).alias("all"))
    schema = T.StructType([*last.schema.fields, T.StructField("at", T.LongType()), T.StructField("offset", T.LongType())])
    last = last.groupBy("all").applyInArrow(_fit(capacity), schema).select(*keep, (F.col("from") + F.col("at")).alias("sequence_id"), "offset")
    return full.unionByName(full_left).unionByName(last)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    Every document yields its tokens and an end token; a null or empty text
    yields the end token alone. Repeated rows and null doc_ids are packed as
    they come, very long texts fill sequences of their own before their rest
    is cut. An empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    return pack(token_pieces(docs, tokenizer or word_bpe_path(), capacity), capacity)


def digest(docs: DataFrame) -> DataFrame:
    """``pack_documents`` with ids_crc32, the CRC-32 of a piece's ids, in place of ids; odd rows are treated as there."""
    packed = pack(token_pieces(docs, word_bpe_path(), checksums=True))
    little = F.concat(*[F.substring(F.hex("ids"), i, 2) for i in (7, 5, 3, 1)])
    crc = F.conv(little, 16, 10).cast("long")
    return packed.select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, tokens and the padding that the sequences need: to the capacity, or none at a power of two."""
    size = F.sum("length")
    each = packed.groupBy("sequence_id").agg(size.alias("n"))
    power = F.bit_count("n") == 1
    return each.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("padding"))
