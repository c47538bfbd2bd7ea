"""Key ranges and what they are assigned to: routing, checks and changes of the layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog import defaults

LAYOUT = "ord int, id string, start_key string, end_key string, leader string, replicas array<struct<node_id:string,role:string,healthy:boolean>>"
CASE_LIMIT = 64  # shards up to which routing is one CASE expression


def layout(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(id, start, end, leader, [replica nodes]) in key order; None or an empty bound is open."""
    out = []
    for i, (name, start, end, leader, nodes) in enumerate(rows):
        reps = [(n, "leader" if n == leader else "follower", True) for n in nodes]
        out.append((i, name, start or "", end or "", leader, reps))
    return spark.createDataFrame(out, LAYOUT)


def _owner(shards: list, what: str):
    expr = F.lit(None).cast("string")
    for s in reversed(shards):
        ok = F.col("key") >= F.lit(s["start_key"])
        if s["end_key"]:
            ok = ok & (F.col("key") < F.lit(s["end_key"]))
        expr = F.when(ok, F.lit(s[what])).otherwise(expr)
    return expr


def route(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` with shard_id and leader; null in a gap between shards.

    Layouts are driver-side state. A small one becomes a CASE expression that
    stays inside the scan's stage. In a larger one each row searches the sorted
    start keys, which go to every task; more than a million shards are refused.
    """
    few = shards.orderBy("ord").limit(CASE_LIMIT + 1).collect()
    if len(few) <= CASE_LIMIT:
        return rows.withColumn("shard_id", _owner(few, "id")).withColumn("leader", _owner(few, "leader"))
    return route_by_search(rows, shards)


def route_by_search(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """As ``route``, for many shards: a binary search over the start keys, a batch of rows at a time. They go to every task, at most some tens of MB."""
    known = [(r["start_key"], r["end_key"], r["id"], r["leader"]) for r in shards.orderBy("start_key").collect()]
    if len(known) > 1_000_000:
        raise ValueError("a layout of more than a million shards")
    columns = [np.array([k[i] for k in known], dtype=object) for i in range(4)]

    @F.pandas_udf("struct<shard_id:string,leader:string>")
    def find(key: pd.Series) -> pd.DataFrame:
        starts, ends, ids, leaders = columns
        if not len(starts):
            return pd.DataFrame({"shard_id": [None] * len(key), "leader": [None] * len(key)})
        plain = key.fillna("").to_numpy(dtype=object)
        at = np.searchsorted(starts, plain, side="right") - 1  # -1 is below the first start and looks at the last shard, but is no hit
        hit = (at >= 0) & key.notna().to_numpy() & ((ends[at] == "") | (plain < ends[at]))
        return pd.DataFrame({"shard_id": np.where(hit, ids[at], None), "leader": np.where(hit, leaders[at], None)})

    return rows.withColumn("_r", find("key")).withColumn("shard_id", F.col("_r.shard_id")).withColumn("leader", F.col("_r.leader")).drop("_r")


def validate(shards: DataFrame) -> DataFrame:
    """ord, id and problem of each shard: null if the layout is right there (gaps are allowed)."""
    w = Window.orderBy("ord")
    before, last = F.lag("end_key").over(w), F.lead("id").over(w).isNull()
    start, end = F.col("start_key"), F.col("end_key")
    problem = (
        F.when((end != "") & (start >= end), "start_not_below_end")
        .when((end == "") & ~last, "open_end_not_last")
        .when((F.col("ord") > 0) & (start == ""), "open_start_not_first")
        .when(before.isNotNull() & (before != "") & (start < before), "overlap")
    )
    return shards.select("ord", "id", problem.alias("problem"))


def transfer(shards: DataFrame, shard_id: str, target: str) -> DataFrame:
    """``target`` leads the shard: it is added to the replicas if absent, and roles follow."""
    here = F.col("id") == shard_id
    have = F.exists("replicas", lambda r: r["node_id"] == target)
    new = F.struct(F.lit(target).alias("node_id"), F.lit("leader").alias("role"), F.lit(True).alias("healthy"))
    roles = F.transform("replicas", lambda r: F.struct(r["node_id"].alias("node_id"), F.when(r["node_id"] == target, "leader").otherwise("follower").alias("role"), r["healthy"].alias("healthy")))
    return shards.withColumn("replicas", F.when(here, F.when(have, roles).otherwise(F.concat(roles, F.array(new)))).otherwise(F.col("replicas"))).withColumn(
        "leader", F.when(here, F.lit(target)).otherwise(F.col("leader"))
    )


def split(shards: DataFrame, shard_id: str, at: str) -> DataFrame:
    """The shard in two at ``at``, strictly inside its range; ids get -a and -b, numbered on where these are taken."""
    ids = {r["id"] for r in shards.select("id").collect()}  # a layout is small
    names = []
    for tail in ("a", "b"):
        name, k = f"{shard_id}-{tail}", 2
        while name in ids:
            name, k = f"{shard_id}-{tail}-{k}", k + 1
        ids.add(name)
        names.append(name)
    inside = (F.col("start_key") < at) & ((F.col("end_key") == "") | (F.col("end_key") > at))
    here = (F.col("id") == shard_id) & inside
    one = F.struct(F.col("id"), F.col("start_key"), F.col("end_key"))
    first = F.struct(F.lit(names[0]).alias("id"), F.col("start_key"), F.lit(at).alias("end_key"))
    second = F.struct(F.lit(names[1]).alias("id"), F.lit(at).alias("start_key"), F.col("end_key"))
    out = shards.select("*", F.posexplode(F.when(here, F.array(first, second)).otherwise(F.array(one))).alias("_pos", "_part"))
    order = Window.orderBy("ord", "_pos")
    return out.select((F.row_number().over(order) - 1).cast("int").alias("ord"), "_part.id", "_part.start_key", "_part.end_key", "leader", "replicas")


def drain(shards: DataFrame, node: str) -> DataFrame:
    """Leaders after ``node`` gave up its shards, and whether that can be done at all.

    Each of its shards goes to the first healthy other replica; if one has
    none, ``drained`` is false and no leader changes.
    """
    led = F.col("leader") == node
    other = F.get(F.filter("replicas", lambda r: (r["node_id"] != node) & r["healthy"]), F.lit(0))["node_id"]
    able = F.min(F.when(led, other.isNotNull()).otherwise(F.lit(True))).over(Window.partitionBy(F.lit(1)))
    return shards.withColumn("drained", able).withColumn("leader", F.when(led & F.col("drained"), other).otherwise(F.col("leader")))


def admission(rows: DataFrame, shards: DataFrame, node: str, draining: bool = False) -> DataFrame:
    """``rows`` with the error that refuses a write on ``node``: backpressure while draining, then no shard, then another leader."""
    routed = route(rows, shards)
    code = F.when(F.lit(draining), "backpressure").when(F.col("shard_id").isNull(), "shard_not_found").when(F.col("leader") != node, "not_leader")
    return routed.withColumn("error", code)


def http_status(error) -> tuple:
    """Status and retry columns for an error column; no error is 200."""
    status, retry = F.lit(defaults.OTHER_ERROR[1]), F.lit(False)
    for name, (number, again) in defaults.WRITE_ERRORS.items():
        status = F.when(error == name, F.lit(number)).otherwise(status)
        retry = F.when(error == name, F.lit(again)).otherwise(retry)
    return F.when(error.isNull(), F.lit(200)).otherwise(status), F.when(error.isNull(), F.lit(False)).otherwise(retry)
