"""Sharding by a keyed permutation of global row numbers."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm._base import materialize, read

ROUNDS = 6
WALK = 64


def sides(n: int) -> tuple[int, int]:
    """The radices (a, b) of the network: a * b >= n with fewer than a values to spare."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, max(1, -(-n // a))


def _round(left: bool, a: int, b: int, key: int):
    """One round as a function of the halves (it may take one argument only, or Spark would pass an index too)."""

    def step(s: Column) -> Column:
        if left:
            moved = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], F.lit(key)), F.lit(a)), F.lit(a))
            return F.struct(moved.alias("l"), s["r"].alias("r"))
        moved = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], F.lit(key)), F.lit(b)), F.lit(b))
        return F.struct(s["l"].alias("l"), moved.alias("r"))

    return step


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass of the network over 0 .. a*b-1, a permutation of that range.

    The halves are the digits of x in mixed radix; each round adds a keyed
    hash of one half to the other modulo its radix.
    """
    a, b = sides(n)
    halves = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))  # exact below 2**53 rows
    for i in range(ROUNDS):
        # a one-element array lets the next round use the halves without repeating their expression
        halves = F.transform(F.array(halves), _round(i % 2 == 0, a, b, seed * ROUNDS + i))[0]
    return F.transform(F.array(halves), lambda s: s["l"] + s["r"] * F.lit(a))[0]


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of row number x among n: a cycle walk until the value lies below n.

    Fewer than sqrt(n) values of the network lie beyond n, so a walk of more
    than one step is rare; one of more than WALK steps raises an error rather
    than returning a wrong place (below 4096 rows it cannot occur).
    """
    first = feistel(x, n, seed)
    a, b = sides(n)
    if a * b == n:
        return first
    walked = F.aggregate(
        F.array_repeat(F.lit(0), WALK), first, lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, n, seed))
    )
    place = F.when(first < n, first).otherwise(walked)
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def row_numbers(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``df`` with a gapless global ``row_number`` from 0 in the given order, and the count.

    Rows are dealt into ranges of the order, sorted there and numbered by
    range and place; the numbered table is written once, so no later
    recomputation can deal them differently. Offsets have one row per range.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg((F.max(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))) + 1).alias("_n"))
    # one number per range: at most spark.sql.shuffle.partitions of them, whatever the rows
    sizes = sorted((r["_part"], r["_n"]) for r in counts.collect())
    rows, total = [], 0
    for p, k in sizes:
        rows.append((p, total))
        total += k
    offsets = df.sparkSession.createDataFrame(rows, "_part long, _off long")
    out = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("row_number", F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_off", "_at")
    )
    return out, total


def shuffle_shards(df: DataFrame, order: list[Column], shards: int, seed: int = 17) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a reproducible shuffle with row counts at most one apart.

    The permuted row number p gives shard p mod shards and slot p div shards,
    so slots are gapless from 0 in each shard, and either is computable from
    the row number alone. Rows that tie in ``order`` are interchangeable.
    """
    numbered, n = row_numbers(df, order)
    place = numbered.withColumn("_place", permuted(F.col("row_number"), max(n, 1), seed))
    return place.withColumn("shard", (F.col("_place") % shards).cast("int")).withColumn(
        "slot", ((F.col("_place") - F.col("_place") % shards) / shards).cast("long")
    ).drop("_place", "row_number")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts of shards are at most one apart. Row numbers
    follow (doc_id, crc, hash), so repeated rows differ in nothing that is
    returned. Null text: size 1 and the CRC of no bytes. A null doc_id sorts
    first. No rows give no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_tie"),
    )
    out = shuffle_shards(narrow, [F.col("doc_id"), F.col("text_crc32"), F.col("_tie")], shards, seed)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), shards=8)
