"""Newest version of a key, visibility of tombstones, and key ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_range(start=None, end=None, key: str = "key") -> Column:
    """Half-open bounds; None or an empty bound is open, and start >= end matches nothing."""
    found = F.lit(True)
    if start:
        found = found & (F.col(key) >= F.lit(start))
    if end:
        found = found & (F.col(key) < F.lit(end))
    return found


def newest(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per key: the highest seq, a tombstone before a value where they tie.

    Filters on the key may follow (they are pushed below); a filter on seq
    must come before, and one on tombstone must come after.
    """
    w = Window.partitionBy(*(keys or ["key"])).orderBy(F.desc("seq"), F.desc("tombstone"))
    return log.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def visible(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newest rows that are not deletions; a tombstone hides all older versions of its key."""
    return newest(log, keys).filter(~F.col("tombstone"))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The log as a snapshot at ``seq`` sees it."""
    return log.filter(F.col("seq") <= F.lit(seq))


def scan(log: DataFrame, start=None, end=None) -> DataFrame:
    """Live keys of [start, end) in key order."""
    return visible(log.filter(in_range(start, end))).select("key", "value", "seq").orderBy("key")


def get(log: DataFrame, keys: list) -> DataFrame:
    """The newest row of each asked key that has one, with ``found`` false for a deletion."""
    return newest(log.filter(F.col("key").isin(keys))).withColumn("found", ~F.col("tombstone"))
