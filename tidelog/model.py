"""The mutation logs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import ship

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str, after: int | None = None, until: int | None = None) -> DataFrame:
    """Mutation log M1: one put or delete of a user's key for every event, of the sequence numbers (after, until].

    The bounds are literals on the stored column, so that they reach the scan.
    """
    dead = F.col("event_type") == "error"
    rows = table(spark, sf_dir, "events")
    rows = rows if after is None else rows.filter(F.col("event_id") >= after)
    rows = rows if until is None else rows.filter(F.col("event_id") < until)
    return rows.select(
        F.format_string("u%06d", "user_id").alias("key"),
        F.when(~dead, F.col("props")).alias("value"),
        dead.alias("tombstone"),
        (F.col("event_id") + 1).alias("seq"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutation log M2: one put or delete of a customer's key for every order."""
    dead = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.format_string("c%06d", "o_custkey").alias("key"),
        F.when(~dead, F.col("o_orderpriority")).alias("value"),
        dead.alias("tombstone"),
        (F.col("o_orderkey") + 1).alias("seq"),
    )
