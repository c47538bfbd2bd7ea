"""Change events and pages of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from tidelog import defaults
from tidelog.operators import shards as routing


def events(log: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """Change events of a log: the offset is the sequence number, the shard that of the key.

    Without shards all events belong to one; events without a shard or with
    offset zero are left out. A log with committed_at has it in its events.
    """
    routed = routing.route(log, shards) if shards is not None else log.withColumn("shard_id", F.lit(defaults.DEFAULT_SHARD))
    return routed.filter("shard_id IS NOT NULL AND shard_id <> '' AND seq > 0").select(
        F.col("seq").alias("offset"), "shard_id", F.when(F.col("tombstone"), "delete").otherwise("put").alias("operation"), "key", "value", "tombstone",
        *(["committed_at"] if "committed_at" in log.columns else []),
    )


def retained(events: DataFrame, keep: int = defaults.CDC_RETAIN) -> DataFrame:
    """The last ``keep`` events of each shard. Shards are few and may be large; the rank filter is pushed into the sort."""
    w = Window.partitionBy("shard_id").orderBy(F.desc("offset"))
    return events.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= keep).drop("_rank")


def page_limit(limit: int) -> int:
    return defaults.CDC_PAGE if limit <= 0 else min(limit, defaults.CDC_PAGE_MAX)


def page(events: DataFrame, shard_id: str, after: int, limit: int = 0) -> DataFrame:
    """Events of a shard with offsets above ``after`` in order, at most a page."""
    return events.filter((F.col("shard_id") == shard_id) & (F.col("offset") > after)).orderBy("offset").limit(page_limit(limit))


def flags(retained: DataFrame, after: int, limit: int = 0, shards: DataFrame | None = None) -> DataFrame:
    """What a reader of each shard at ``after`` is told: next and oldest offset, and whether events were dropped before.

    A known shard without events gives an empty page whose next offset is the
    reader's own. Each task keeps a page of the lowest new offsets of a shard
    and no more, so a shard of any size is neither sorted nor brought together.
    """
    n = page_limit(limit)
    first = InternalFunction.collect_top_k(F.when(F.col("offset") > after, F.col("offset")), n, True)  # the n least, equal ones too, without nulls
    by = retained.groupBy("shard_id").agg(first.alias("_page"), F.min("offset").alias("oldest"))
    by = by.select("shard_id", F.array_max("_page").alias("last"), "oldest", F.size("_page").alias("events"))
    if shards is not None:
        by = shards.select(F.col("id").alias("shard_id")).join(by, "shard_id", "left")
    oldest = F.coalesce("oldest", F.lit(0)).cast("long")
    return by.select(
        "shard_id", F.lit(after).cast("long").alias("from_offset"), F.coalesce("last", F.lit(after)).cast("long").alias("next_offset"),
        oldest.alias("oldest_offset"), ((oldest > 0) & (F.lit(after + 1) < oldest)).alias("dropped_before"), F.coalesce("events", F.lit(0)).cast("long").alias("events"),
    )
