"""Checks of mutations before they are committed, and their sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import defaults


def record_size(key: str = "key", value: str = "value") -> Column:
    return (F.lit(defaults.RECORD_OVERHEAD) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def reject_code(limit: int = defaults.WAL_BLOCK) -> Column:
    """Why a mutation is refused, or null: an empty key, an empty value of a put, a record beyond ``limit``."""
    empty_key = F.coalesce(F.octet_length("key"), F.lit(0)) == 0
    empty_value = ~F.col("tombstone") & (F.coalesce(F.octet_length("value"), F.lit(0)) == 0)
    return F.when(empty_key, "empty_key").when(empty_value, "empty_value").when(record_size() > limit, "record_too_large")


def split_valid(log: DataFrame, limit: int = defaults.WAL_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Accepted mutations, and refused ones with their code."""
    coded = log.withColumn("code", reject_code(limit))
    return coded.filter("code IS NULL").drop("code"), coded.filter("code IS NOT NULL")


def committed(log: DataFrame) -> DataFrame:
    """Rows whose sequence number is a committed index: at least one."""
    return log.filter(F.col("seq") >= 1)


def observed_seq(log: DataFrame) -> DataFrame:
    """The highest committed index, from which numbering goes on; zero for an empty log."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("last_seq"), (F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("long").alias("next_seq"))


def sequence(log: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """Gapless commit indexes in ``order`` after ``after``, without bringing all rows to one task.

    Rows are dealt into ranges of the order and numbered within them; only the
    ranges' counts come together. For a log too large to range-sort twice,
    keep the source's own index instead.
    """
    ranged = log.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    start, offsets = after, {}
    for p in sorted(counts):
        offsets[p] = start
        start += counts[p]
    table = log.sparkSession.createDataFrame(list(offsets.items()), "_p long, _off long")
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn("seq", F.col("_off") + local + 1).drop("_p", "_off", "_at")
