"""Queries over the driver's tables, one or more for each operator, with their SQL.

Two mutation logs stand behind them (see ``tidelog.model``): m1 over events
and m2 over orders. Runs are cut every 1000 sequence numbers, and shards leave
a gap so that every outcome of routing occurs.
"""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from tidelog import defaults, model
from tidelog.functions import bytesx
from tidelog.operators import admission, blocks, cdc, runs, shards, versions
from tidelog.streaming import ingest

POINT = "u000005"
SOME = ["u000001", "u000007", "u000042", "u000149"]
ABSENT = ["u000001", "u999999", "x"]
KEY = "u000077"
COMPACTED = 4  # runs 0 .. 3 lie on level 1
SHARDS = [
    ("s1", "u000000", "u000050", "node-0", ["node-0", "node-1"]),
    ("s2", "u000050", "u000100", "node-1", ["node-1", "node-2", "node-0"]),
    ("s3", "u000120", "", "node-0", ["node-0", "node-2"]),
]


def m1(spark, sf):
    return model.event_log(spark, sf)


def m2(spark, sf):
    return model.order_log(spark, sf)


def layout(spark):
    return shards.layout(spark, SHARDS)


def last_seq(spark, sf) -> int:
    """The checkpoint of m1, which a store has in its manifest: one number, from the column's statistics."""
    return m1(spark, sf).agg(F.max("seq")).first()[0] or 0


def snapshot_at(spark, sf, divide: int):
    """m1 as a snapshot at a fraction of its checkpoint sees it; the bound is a literal that the scan gets."""
    return model.event_log(spark, sf, until=last_seq(spark, sf) // divide)


# --- reads


def get_newest_all(spark, sf):
    return versions.newest(m1(spark, sf))


def get_newest_orders(spark, sf):
    return versions.newest(m2(spark, sf))


def get_point(spark, sf):
    return versions.get(m1(spark, sf), [POINT])


def multi_get(spark, sf):
    return versions.get(m1(spark, sf), SOME)


def get_missing_key(spark, sf):
    asked = spark.createDataFrame([(k,) for k in ABSENT], "key string")
    have = versions.get(m1(spark, sf), ABSENT).select("key", "value", "found")
    return asked.join(have, "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def snapshot_get_asof(spark, sf):
    return versions.get(snapshot_at(spark, sf, 2), SOME)


def snapshot_range(spark, sf):
    return versions.scan(snapshot_at(spark, sf, 2), "u000003", "u000090")


def snapshot_diff(spark, sf):
    old = versions.visible(snapshot_at(spark, sf, 4)).select("key", F.col("seq").alias("old_seq"))
    new = versions.visible(snapshot_at(spark, sf, 2)).select("key", F.col("seq").alias("new_seq"))
    change = F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed").otherwise("changed")
    return old.join(new, "key", "full").filter("NOT (old_seq <=> new_seq)").select("key", "old_seq", "new_seq", change.alias("change"))


def ranged(start, end):
    return lambda spark, sf: versions.scan(m1(spark, sf), start, end)


def range_limit(spark, sf):
    return versions.scan(m1(spark, sf)).limit(25)


def merge_runs_newest(spark, sf):
    return versions.visible(runs.by_run(m1(spark, sf))).select("key", "value", "seq", "run")


def empty_scan(spark, sf):
    return versions.scan(m1(spark, sf).filter("seq < 0"))


# --- writes


def dirty(spark, sf):
    """m2 with keys and values emptied by rule, and some values made long."""
    log, n = m2(spark, sf), F.col("seq")
    value = F.when(~F.col("tombstone") & (n % 89 == 0), "").when(~F.col("tombstone") & (n % 83 == 0), F.repeat(F.lit("x"), 200)).otherwise(F.col("value"))
    return log.select(F.when(n % 97 == 0, "").otherwise(F.col("key")).alias("key"), value.alias("value"), "tombstone", "seq")


def reject_invalid(spark, sf):
    return admission.split_valid(dirty(spark, sf), 128)[1].select("seq", "code")


def accepted_size(spark, sf):
    ok = admission.split_valid(dirty(spark, sf), 128)[0]
    return ok.agg(F.count(F.lit(1)).alias("accepted"), F.sum(admission.record_size()).cast("long").alias("record_bytes"))


def committed_entries(spark, sf):
    shifted = m1(spark, sf).withColumn("seq", F.col("seq") - 3)
    return admission.committed(shifted).select("seq", "key")


def observe_seq(spark, sf):
    return admission.observed_seq(m1(spark, sf))


def commit_sequence(spark, sf):
    log = model.table(spark, sf, "orders").select(F.format_string("c%06d", "o_custkey").alias("key"), "o_orderdate", "o_orderkey")
    return admission.sequence(log, ["o_orderdate", "o_orderkey"], after=100).select("o_orderkey", "seq")


# --- memtable


def memtable_live_size(spark, sf):
    new = versions.newest(m1(spark, sf))
    return new.agg(F.sum(runs.live_size()).cast("long").alias("live_bytes"), F.count(F.lit(1)).alias("entries"), F.sum(F.col("tombstone").cast("long")).alias("tombstones"))


def fnv_shard_counts(spark, sf):
    new = versions.newest(m1(spark, sf)).withColumn("shard", bytesx.hash_shard(F.col("key"), 16))
    return new.groupBy("shard").agg(F.count(F.lit(1)).alias("entries"), F.sum(runs.live_size()).cast("long").alias("bytes"))


# --- runs


def meta(spark, sf, every=1000):
    return runs.metadata(runs.by_run(m1(spark, sf), every), F.when(F.col("run") < COMPACTED, 1).otherwise(0))


def run_metadata(spark, sf):
    return meta(spark, sf)


def run_prune_key(spark, sf):
    return runs.prune_key(meta(spark, sf, 40), KEY).select("path", "min_key", "max_key")


def run_prune_range(spark, sf):
    return runs.prune_range(meta(spark, sf, 40), "u000010", "u000012").select("path", "min_key", "max_key")


def pruned_get(spark, sf):
    """A point read that looks only into runs whose key range may hold the key."""
    log = m1(spark, sf)
    may = runs.prune_key(runs.metadata(runs.by_run(log, 1000)), KEY).select("path")
    own = runs.by_run(log.filter(F.col("key") == KEY), 1000)  # the key's rows alone are ranked
    return versions.get(own.withColumn("path", runs.path_of(F.col("run"))).join(may, "path", "left_semi"), [KEY]).select("key", "value", "seq", "found")


def block_packing(spark, sf):
    return blocks.blocks(runs.by_run(m1(spark, sf)), 2048)


def bloom_probe(spark, sf):
    """False answers of a filter over the even keys: none may be missed, few others found."""
    import pandas as pd

    def probe(pdf):
        held, other = pdf["key"][pdf["n"] % 2 == 0].tolist(), pdf["key"][pdf["n"] % 2 == 1].tolist()
        f = bytesx.Bloom(len(held), defaults.BLOOM_BITS)
        f.add(held)
        return pd.DataFrame([(len(held), int((~f.might_hold(held)).sum()) if held else 0, len(other), int(f.might_hold(other).sum()) if other else 0)], columns=["held", "missed", "others", "false_positives"])

    keys = runs.by_run(m1(spark, sf)).select("run", "key", F.substring("key", 2, 6).cast("long").alias("n"))
    return keys.groupBy("run").applyInPandas(probe, "held long, missed long, others long, false_positives long")


def prefix_shared(spark, sf):
    """Bytes that each key of a run shares with the one before it; every RESTART_EVERY-th is whole."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("key")
    rows = runs.by_run(m1(spark, sf)).select("run", "key", (F.row_number().over(w) - 1).alias("at"), F.lag("key").over(w).alias("before"))
    return rows.select("run", "key", F.when(F.col("at") % defaults.RESTART_EVERY == 0, 0).otherwise(bytesx.shared_prefix("before", "key")).cast("long").alias("shared"))


# --- compaction


def compaction(drop):
    """A merge of all runs, so that no older version lies below it and tombstones may go."""
    return lambda spark, sf: runs.merge(runs.by_run(m1(spark, sf)), drop).select("key", "value", "tombstone", "seq")


def compaction_obsolete_versions(spark, sf):
    rows = runs.by_run(m1(spark, sf))
    return rows.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("obsolete")).filter("obsolete > 0")


def level_state(spark, sf):
    return runs.level_state(meta(spark, sf))


def overlap_pairs(spark, sf):
    """All pairs of runs whose key ranges meet. Their number grows with the square of the runs where keys are spread evenly."""
    m = meta(spark, sf)
    return m.alias("a").join(m.alias("b"), (F.col("a.path") < F.col("b.path")) & runs.overlaps("a", "b")).select(F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"))


def plan_l0(spark, sf):
    """Level 0 with four runs or more merges with what it meets on level 1."""
    m = meta(spark, sf)
    l0, l1 = m.filter("level = 0"), m.filter("level = 1")
    full = l0.agg((F.count(F.lit(1)) >= 4).alias("full"))
    met = l1.alias("b").join(l0.alias("a"), runs.overlaps("a", "b"), "left_semi").select("b.path")
    return l0.select("path").unionByName(met).distinct().crossJoin(F.broadcast(full)).filter("full").select("path", F.lit(1).alias("output_level"))


def plan_level_size(spark, sf):
    """Levels above their size: 1000 bytes times ten for each level below the first."""
    return runs.level_state(meta(spark, sf)).filter("level > 0").withColumn("limit", (F.lit(1000) * F.pow(F.lit(10.0), F.col("level") - 1)).cast("long")).filter(F.col("size_bytes") > F.col("limit")).select("level", "size_bytes", "limit")


def safe_tombstone_drop(spark, sf):
    """Tombstones of level 0 whose key no run below level 0 covers: these may go for good."""
    rows, m = runs.by_run(m1(spark, sf)), meta(spark, sf)
    top = versions.newest(rows.filter(F.col("run") >= COMPACTED)).filter("tombstone")
    deep = m.filter("level = 1").select("min_key", "max_key")
    return top.join(F.broadcast(deep), (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key")), "left_anti").select("key", "seq")


# --- registry and recovery


def manifest_merge(spark, sf):
    m = meta(spark, sf)
    removed = m.filter("level = 1").select("path")
    added = m.filter("level = 1").agg(
        F.lit("run-merged").alias("path"), F.lit(2).alias("level"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"),
        F.min("seq_min").alias("seq_min"), F.max("seq_max").alias("seq_max"), F.sum("size_bytes").cast("long").alias("size_bytes"), F.sum("entry_count").cast("long").alias("entry_count"),
    )
    return runs.merge_manifest(m, removed, added).select("path", "level", "seq_max", "entry_count")


def registry_order(spark, sf):
    return runs.registry_order(meta(spark, sf)).select("path", "seq_max", "position")


def resolve_missing(spark, sf):
    asked = spark.createDataFrame([("run-000000",), ("run-000003",), ("missing",)], "path string")
    return asked.join(meta(spark, sf).select("path"), "path", "left_anti")


def fallback_scan(spark, sf):
    m = meta(spark, sf).withColumn("level", F.lit(0))
    high = m.agg(F.max("seq_max").alias("wal_seq"))
    return m.crossJoin(F.broadcast(high)).select("path", "level", "seq_max", "wal_seq")


def replay_tail(spark, sf):
    return model.event_log(spark, sf, after=last_seq(spark, sf) - 500).select("seq", "key", "tombstone")


def wal_segment_gaps(spark, sf):
    from tidelog.sources import wal

    ids = runs.by_run(m1(spark, sf)).select((F.col("run") + 1).alias("id")).distinct().filter("id <> 3")
    return wal.gaps(ids).select("id", "expected")


def trash_retention(spark, sf):
    files = meta(spark, sf).select("path", F.col("size_bytes").alias("size"), F.col("seq_max").alias("mtime"))
    return runs.trash_kept(files, 6, 12_000).select("path", "size", "total")


# --- shards


def route_keys(spark, sf):
    return shards.route(versions.newest(m1(spark, sf)).select("key"), layout(spark)).select("key", "shard_id", "leader")


def route_gaps(spark, sf):
    return shards.route(versions.newest(m1(spark, sf)).select("key"), layout(spark)).filter("shard_id IS NULL").select("key")


def shard_counts(spark, sf):
    return shards.route(m1(spark, sf), layout(spark)).groupBy("shard_id").agg(F.count(F.lit(1)).alias("rows"))


def shard_search(spark, sf):
    """Routing of many shards by a search over their starts: one for every ten keys."""
    many = shards.layout(spark, [(f"t{i:03d}", f"u{10 * i:06d}", f"u{10 * i + 8:06d}", "node-0", ["node-0"]) for i in range(100)])
    return shards.route(m1(spark, sf), many).groupBy("shard_id").agg(F.count(F.lit(1)).alias("rows"))


def layout_validate(spark, sf):
    bad = [("a", "", "g", "n", ["n"]), ("b", "f", "m", "n", ["n"]), ("c", "m", "m", "n", ["n"]), ("d", "p", "", "n", ["n"]), ("e", "", "z", "n", ["n"])]
    return shards.validate(shards.layout(spark, bad)).select("id", "problem")


def admission_codes(spark, sf):
    coded = shards.admission(m1(spark, sf), layout(spark), "node-0")
    return coded.groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


def admission_draining(spark, sf):
    return shards.admission(m1(spark, sf), layout(spark), "node-0", draining=True).groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


def error_http_codes(spark, sf):
    coded = shards.admission(m1(spark, sf), layout(spark), "node-0")
    status, retry = shards.http_status(F.col("error"))
    hint = F.when(retry, F.col("shard_id"))
    return coded.select(status.alias("status"), retry.alias("retryable"), hint.alias("route_hint")).groupBy("status", "retryable", "route_hint").agg(F.count(F.lit(1)).alias("rows"))


def shard_split(spark, sf):
    return shards.split(layout(spark), "s2", "u000075").select("ord", "id", "start_key", "end_key", "leader")


def shard_transfer(spark, sf):
    moved = shards.transfer(layout(spark), "s1", "node-9")
    return moved.select("id", "leader", F.explode("replicas").alias("r")).select("id", "leader", "r.node_id", "r.role", "r.healthy")


def shard_drain(spark, sf):
    return shards.drain(layout(spark), "node-0").select("id", "leader", "drained")


def shard_drain_refused(spark, sf):
    alone = shards.layout(spark, [*SHARDS, ("s9", "v", "", "node-0", ["node-0"])])
    return shards.drain(alone, "node-0").select("id", "leader", "drained")


def cluster_shards_b64(spark, sf):
    return layout(spark).select("id", F.base64(F.col("start_key").cast("binary")).alias("start_b64"), F.base64(F.col("end_key").cast("binary")).alias("end_b64"), "leader")


# --- change stream


def change_events(spark, sf):
    return cdc.events(m1(spark, sf), layout(spark))


def cdc_events(spark, sf):
    return change_events(spark, sf)


def cdc_page(spark, sf):
    return cdc.page(change_events(spark, sf), "s1", 500, 20)


def cdc_page_b64(spark, sf):
    p = cdc.page(change_events(spark, sf), "s2", 100, 10)
    return p.select("offset", "operation", F.base64(F.col("key").cast("binary")).alias("key_b64"), F.base64(F.col("value").cast("binary")).alias("value_b64"))


def cdc_retention(spark, sf):
    return cdc.retained(change_events(spark, sf), 300).select("shard_id", "offset")


def cdc_flags(spark, sf):
    return cdc.flags(cdc.retained(change_events(spark, sf), 300), 50, 100)


def cdc_empty_shard(spark, sf):
    wide = shards.layout(spark, [*SHARDS[:2], ("s3", "u000120", "v", "node-0", ["node-0"]), ("s4", "v", "", "node-0", ["node-0"])])
    return cdc.flags(cdc.events(m1(spark, sf), wide), 12, 5, wide)


def cdc_limit_norm(spark, sf):
    asked = [-5, 0, 1, 100, 1000, 1001, 5000]
    return spark.createDataFrame([(n, cdc.page_limit(n)) for n in asked], "asked long, used long")


# --- requests and statistics


def write_status_eviction(spark, sf):
    """Requests that a store for 80 of each 100 keeps: the oldest that are not pending go first, pending ones never."""
    from pyspark.sql import Window

    reqs = model.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("committed").alias("state"))
    total = reqs.agg(F.floor(F.count(F.lit(1)) / 5).alias("over"))
    done = reqs.filter("state <> 'pending'")
    # only requests that may go are ranked; a node's store is bounded by its own limit
    gone = done.withColumn("age", F.row_number().over(Window.orderBy("request_id"))).crossJoin(F.broadcast(total)).filter("age <= over").select("request_id")
    return reqs.join(gone, "request_id", "left_anti").groupBy("state").agg(F.count(F.lit(1)).alias("kept"), F.min("request_id").alias("oldest"))


def engine_stats(spark, sf):
    log = m1(spark, sf)
    rows = runs.by_run(log)
    a = log.agg(F.count(F.lit(1)).alias("mutations"), F.max("seq").alias("last_seq"), F.sum(F.col("tombstone").cast("long")).alias("deletes"))
    b = rows.agg(F.countDistinct("run").alias("runs"), F.count(F.lit(1)).alias("entries"), F.sum(runs.live_size()).cast("long").alias("bytes"))
    return a.crossJoin(F.broadcast(b))


QUERIES = {
    "get_newest_all": get_newest_all, "get_newest_orders": get_newest_orders, "get_point": get_point, "multi_get": multi_get, "get_missing_key": get_missing_key,
    "snapshot_get_asof": snapshot_get_asof, "snapshot_range": snapshot_range, "snapshot_diff": snapshot_diff,
    "range_closed_open": ranged("u000010", "u000020"), "range_open_start": ranged(None, "u000020"), "range_open_end": ranged("u000120", None), "range_inverted_empty": ranged("u000050", "u000050"),
    "range_limit": range_limit, "merge_runs_newest": merge_runs_newest, "empty_scan": empty_scan,
    "reject_invalid": reject_invalid, "accepted_size": accepted_size, "committed_entries": committed_entries, "observe_seq": observe_seq, "commit_sequence": commit_sequence,
    "memtable_live_size": memtable_live_size, "fnv_shard_counts": fnv_shard_counts,
    "run_metadata": run_metadata, "run_prune_key": run_prune_key, "run_prune_range": run_prune_range, "pruned_get": pruned_get, "block_packing": block_packing, "bloom_probe": bloom_probe, "prefix_shared": prefix_shared,
    "compaction_keep": compaction(False), "compaction_drop": compaction(True), "compaction_obsolete_versions": compaction_obsolete_versions,
    "level_state": level_state, "overlap_pairs": overlap_pairs, "plan_l0": plan_l0, "plan_level_size": plan_level_size, "safe_tombstone_drop": safe_tombstone_drop,
    "manifest_merge": manifest_merge, "registry_order": registry_order, "resolve_missing": resolve_missing, "fallback_scan": fallback_scan, "replay_tail": replay_tail,
    "wal_segment_gaps": wal_segment_gaps, "trash_retention": trash_retention,
    "route_keys": route_keys, "route_gaps": route_gaps, "shard_counts": shard_counts, "shard_search": shard_search, "layout_validate": layout_validate,
    "admission_codes": admission_codes, "admission_draining": admission_draining, "error_http_codes": error_http_codes,
    "shard_split": shard_split, "shard_transfer": shard_transfer, "shard_drain": shard_drain, "shard_drain_refused": shard_drain_refused, "cluster_shards_b64": cluster_shards_b64,
    "cdc_events": cdc_events, "cdc_page": cdc_page, "cdc_page_b64": cdc_page_b64, "cdc_retention": cdc_retention, "cdc_flags": cdc_flags, "cdc_empty_shard": cdc_empty_shard, "cdc_limit_norm": cdc_limit_norm,
    "write_status_eviction": write_status_eviction, "engine_stats": engine_stats,
    "stream_ingest_newest": ingest.stream_ingest_newest, "stream_cdc": ingest.stream_cdc,
}


# --- SQL

M1 = """m1 AS (SELECT printf('u%06d', user_id) AS key, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value,
  event_type = 'error' AS tombstone, event_id + 1 AS seq FROM events)"""
M2 = """m2 AS (SELECT printf('c%06d', o_custkey) AS key, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value,
  o_orderstatus = 'F' AS tombstone, o_orderkey + 1 AS seq FROM orders)"""
BYTES = "strlen(key) + coalesce(strlen(value), 0)"


def _newest(source: str, keys: str = "key") -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC, tombstone DESC) = 1)"


def _runs(every: int = 1000) -> str:
    return f"""{M1}, rr AS (SELECT *, (seq - 1) // {every} AS run FROM m1), r AS {_newest('rr', 'run, key')},
  meta AS (SELECT 'run-' || lpad(run::VARCHAR, 6, '0') AS path, CASE WHEN run < {COMPACTED} THEN 1 ELSE 0 END AS level, min(key) AS min_key, max(key) AS max_key,
    min(seq) AS seq_min, max(seq) AS seq_max, sum({BYTES})::BIGINT AS size_bytes, count(*) AS entry_count FROM r GROUP BY run)"""


def _asof(divide: int) -> str:
    return f"(SELECT * FROM m1 WHERE seq <= (SELECT max(seq) // {divide} FROM m1))"


def _range(where: str) -> str:
    return f"WITH {M1} SELECT key, value, seq FROM {_newest('m1')} WHERE NOT tombstone AND {where}"


def _in(keys: list[str]) -> str:
    return ", ".join(f"'{k}'" for k in keys)


_LAYOUT = "sh AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{a}', '{b}', '{led}')" for i, (n, a, b, led, _) in enumerate(SHARDS)) + ") t(ord, id, start_key, end_key, leader))"
_ROUTED = f"{M1}, {_LAYOUT}, routed AS (SELECT m1.*, sh.id AS shard_id, sh.leader FROM m1 LEFT JOIN sh ON m1.key >= start_key AND (end_key = '' OR m1.key < end_key))"
_EVENTS = f"{_ROUTED}, ev AS (SELECT seq AS \"offset\", shard_id, CASE WHEN tombstone THEN 'delete' ELSE 'put' END AS operation, key, value, tombstone FROM routed WHERE shard_id IS NOT NULL)"
_DIRTY = f"""{M2}, d AS (SELECT CASE WHEN seq % 97 = 0 THEN '' ELSE key END AS key, CASE WHEN NOT tombstone AND seq % 89 = 0 THEN '' WHEN NOT tombstone AND seq % 83 = 0
  THEN repeat('x', 200) ELSE value END AS value, tombstone, seq FROM m2), coded AS (SELECT *, CASE WHEN key = '' THEN 'empty_key' WHEN NOT tombstone AND value = '' THEN 'empty_value'
  WHEN 21 + {BYTES} > 128 THEN 'record_too_large' END AS code FROM d)"""
_ERROR = "CASE WHEN shard_id IS NULL THEN 'shard_not_found' WHEN leader <> 'node-0' THEN 'not_leader' END"
_KEPT = "kept AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY \"offset\" DESC) <= 300)"


def _flags(source: str, after: int, limit: int) -> str:
    return f"""seen AS (SELECT *, row_number() OVER (PARTITION BY shard_id, "offset" > {after} ORDER BY "offset") AS place FROM {source}),
  f AS (SELECT shard_id, max(CASE WHEN "offset" > {after} AND place <= {limit} THEN "offset" END) AS last, min("offset") AS oldest,
    sum(CASE WHEN "offset" > {after} AND place <= {limit} THEN 1 ELSE 0 END) AS n FROM seen GROUP BY shard_id)"""


_FLAG_COLUMNS = """{after}::BIGINT AS from_offset, coalesce(last, {after})::BIGINT AS next_offset, coalesce(oldest, 0)::BIGINT AS oldest_offset,
  coalesce(oldest, 0) > 0 AND {after} + 1 < coalesce(oldest, 0) AS dropped_before, coalesce(n, 0)::BIGINT AS events"""

ORACLE = {
    "get_newest_all": f"WITH {M1} SELECT key, value, tombstone, seq FROM {_newest('m1')}",
    "get_newest_orders": f"WITH {M2} SELECT key, value, tombstone, seq FROM {_newest('m2')}",
    "get_point": f"WITH {M1} SELECT key, value, tombstone, seq, NOT tombstone AS found FROM {_newest('m1')} WHERE key = '{POINT}'",
    "multi_get": f"WITH {M1} SELECT key, value, tombstone, seq, NOT tombstone AS found FROM {_newest('m1')} WHERE key IN ({_in(SOME)})",
    "get_missing_key": f"WITH {M1}, n AS {_newest('m1')} SELECT k.key, n.value, coalesce(NOT n.tombstone, false) AS found FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in ABSENT)}) k(key) LEFT JOIN n USING (key)",
    "snapshot_get_asof": f"WITH {M1} SELECT key, value, tombstone, seq, NOT tombstone AS found FROM {_newest(_asof(2))} WHERE key IN ({_in(SOME)})",
    "snapshot_range": f"WITH {M1} SELECT key, value, seq FROM {_newest(_asof(2))} WHERE NOT tombstone AND key >= 'u000003' AND key < 'u000090' ORDER BY key",
    "snapshot_diff": f"""WITH {M1}, o AS (SELECT key, seq AS old_seq FROM {_newest(_asof(4))} WHERE NOT tombstone), n AS (SELECT key, seq AS new_seq FROM {_newest(_asof(2))} WHERE NOT tombstone)
      SELECT key, old_seq, new_seq, CASE WHEN old_seq IS NULL THEN 'added' WHEN new_seq IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (key) WHERE old_seq IS DISTINCT FROM new_seq""",
    "range_closed_open": _range("key >= 'u000010' AND key < 'u000020'"),
    "range_open_start": _range("key < 'u000020'"),
    "range_open_end": _range("key >= 'u000120'"),
    "range_inverted_empty": _range("key >= 'u000050' AND key < 'u000050'"),
    "range_limit": _range("true") + " ORDER BY key LIMIT 25",
    "merge_runs_newest": f"WITH {_runs()} SELECT key, value, seq, run FROM {_newest('r')} WHERE NOT tombstone",
    "empty_scan": f"WITH {M1} SELECT key, value, seq FROM m1 WHERE seq < 0",
    "reject_invalid": f"WITH {_DIRTY} SELECT seq, code FROM coded WHERE code IS NOT NULL",
    "accepted_size": f"WITH {_DIRTY} SELECT count(*) AS accepted, sum(21 + {BYTES})::BIGINT AS record_bytes FROM coded WHERE code IS NULL",
    "committed_entries": f"WITH {M1} SELECT seq - 3 AS seq, key FROM m1 WHERE seq - 3 >= 1",
    "observe_seq": f"WITH {M1} SELECT coalesce(max(seq), 0)::BIGINT AS last_seq, (coalesce(max(seq), 0) + 1)::BIGINT AS next_seq FROM m1",
    "commit_sequence": "SELECT o_orderkey, 100 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders",
    "memtable_live_size": f"WITH {M1} SELECT sum({BYTES})::BIGINT AS live_bytes, count(*) AS entries, sum(CASE WHEN tombstone THEN 1 ELSE 0 END)::BIGINT AS tombstones FROM {_newest('m1')}",
    "run_metadata": f"WITH {_runs()} SELECT * FROM meta",
    "run_prune_key": f"WITH {_runs(40)} SELECT path, min_key, max_key FROM meta WHERE min_key <= '{KEY}' AND max_key >= '{KEY}'",
    "run_prune_range": f"WITH {_runs(40)} SELECT path, min_key, max_key FROM meta WHERE max_key >= 'u000010' AND min_key < 'u000012'",
    "pruned_get": f"WITH {M1} SELECT key, value, seq, NOT tombstone AS found FROM {_newest('m1')} WHERE key = '{KEY}'",
    "prefix_shared": f"""WITH {_runs()}, o AS (SELECT run, key, row_number() OVER w - 1 AS place, lag(key) OVER w AS prior FROM r WINDOW w AS (PARTITION BY run ORDER BY key))
      SELECT run, key, CASE WHEN place % 16 = 0 THEN 0 ELSE len(list_filter(range(1, least(length(key), length(prior)) + 1), lambda i : key[:i] = prior[:i])) END::BIGINT AS shared FROM o""",
    "compaction_keep": f"WITH {_runs()} SELECT key, value, tombstone, seq FROM {_newest('r')}",
    "compaction_drop": f"WITH {_runs()} SELECT key, value, tombstone, seq FROM {_newest('r')} WHERE NOT tombstone",
    "compaction_obsolete_versions": f"WITH {_runs()} SELECT key, count(*) - 1 AS obsolete FROM r GROUP BY key HAVING count(*) > 1",
    "level_state": f"WITH {_runs()} SELECT level, count(*) AS runs, sum(size_bytes)::BIGINT AS size_bytes, min(min_key) AS min_key, max(max_key) AS max_key FROM meta GROUP BY level",
    "overlap_pairs": f"WITH {_runs()} SELECT a.path AS path_a, b.path AS path_b FROM meta a JOIN meta b ON a.path < b.path AND a.min_key <= b.max_key AND b.min_key <= a.max_key",
    "plan_l0": f"""WITH {_runs()}, l0 AS (SELECT * FROM meta WHERE level = 0) SELECT DISTINCT path, 1 AS output_level FROM (SELECT path FROM l0 UNION ALL SELECT b.path FROM meta b WHERE level = 1
      AND EXISTS (SELECT 1 FROM l0 a WHERE a.min_key <= b.max_key AND b.min_key <= a.max_key)) WHERE (SELECT count(*) FROM l0) >= 4""",
    "plan_level_size": f"WITH {_runs()}, s AS (SELECT level, sum(size_bytes)::BIGINT AS size_bytes FROM meta WHERE level > 0 GROUP BY level) SELECT level, size_bytes, (1000 * pow(10, level - 1))::BIGINT AS \"limit\" FROM s WHERE size_bytes > 1000 * pow(10, level - 1)",
    "safe_tombstone_drop": f"WITH {_runs()} SELECT key, seq FROM {_newest(f'(SELECT * FROM r WHERE run >= {COMPACTED})')} t WHERE tombstone AND NOT EXISTS (SELECT 1 FROM meta WHERE level = 1 AND t.key BETWEEN min_key AND max_key)",
    "manifest_merge": f"WITH {_runs()} SELECT path, level, seq_max, entry_count FROM meta WHERE level <> 1 UNION ALL SELECT 'run-merged', 2, max(seq_max), sum(entry_count)::BIGINT FROM meta WHERE level = 1",
    "registry_order": f"WITH {_runs()} SELECT path, seq_max, row_number() OVER (ORDER BY seq_max DESC, path) AS position FROM meta",
    "resolve_missing": f"WITH {_runs()} SELECT path FROM (VALUES ('run-000000'), ('run-000003'), ('missing')) t(path) WHERE path NOT IN (SELECT path FROM meta)",
    "fallback_scan": f"WITH {_runs()} SELECT path, 0 AS level, seq_max, (SELECT max(seq_max) FROM meta) AS wal_seq FROM meta",
    "replay_tail": f"WITH {M1} SELECT seq, key, tombstone FROM m1 WHERE seq > (SELECT max(seq) - 500 FROM m1)",
    "wal_segment_gaps": f"WITH {_runs()}, i AS (SELECT DISTINCT run + 1 AS id FROM r WHERE run + 1 <> 3), n AS (SELECT id, row_number() OVER (ORDER BY id) AS expected FROM i) SELECT id, expected FROM n WHERE id <> expected",
    "trash_retention": f"""WITH {_runs()}, t AS (SELECT path, size_bytes AS size, row_number() OVER w AS rank, sum(size_bytes) OVER w AS total FROM meta WINDOW w AS (ORDER BY seq_max DESC, path DESC ROWS UNBOUNDED PRECEDING))
      SELECT path, size, total::BIGINT AS total FROM t WHERE rank <= 6 AND total <= 12000""",
    "route_keys": f"WITH {_ROUTED} SELECT DISTINCT key, shard_id, leader FROM routed",
    "route_gaps": f"WITH {_ROUTED} SELECT DISTINCT key FROM routed WHERE shard_id IS NULL",
    "shard_counts": f"WITH {_ROUTED} SELECT shard_id, count(*) AS rows FROM routed GROUP BY shard_id",
    "shard_search": f"WITH {M1}, s AS (SELECT CASE WHEN user_id < 1000 AND user_id % 10 < 8 THEN printf('t%03d', user_id // 10) END AS shard_id FROM events) SELECT shard_id, count(*) AS rows FROM s GROUP BY shard_id",
    "layout_validate": "SELECT * FROM (VALUES ('a', NULL), ('b', 'overlap'), ('c', 'start_not_below_end'), ('d', 'open_end_not_last'), ('e', 'open_start_not_first')) t(id, problem)",
    "admission_codes": f"WITH {_ROUTED} SELECT {_ERROR} AS error, count(*) AS rows FROM routed GROUP BY 1",
    "admission_draining": "SELECT 'backpressure' AS error, count(*) AS rows FROM events",
    "error_http_codes": f"""WITH {_ROUTED}, e AS (SELECT *, {_ERROR} AS error FROM routed) SELECT CASE error WHEN 'not_leader' THEN 409 WHEN 'shard_not_found' THEN 404 ELSE 200 END AS status,
      error IS NOT NULL AS retryable, CASE WHEN error IS NOT NULL THEN shard_id END AS route_hint, count(*) AS rows FROM e GROUP BY 1, 2, 3""",
    "shard_split": f"""WITH {_LAYOUT}, p AS (SELECT ord, 0 AS part, id, start_key, end_key, leader FROM sh WHERE id <> 's2' UNION ALL SELECT ord, 0, 's2-a', start_key, 'u000075', leader FROM sh WHERE id = 's2'
      UNION ALL SELECT ord, 1, 's2-b', 'u000075', end_key, leader FROM sh WHERE id = 's2') SELECT (row_number() OVER (ORDER BY ord, part) - 1)::INTEGER AS ord, id, start_key, end_key, leader FROM p""",
    "shard_transfer": """SELECT * FROM (VALUES ('s1', 'node-9', 'node-0', 'follower', true), ('s1', 'node-9', 'node-1', 'follower', true), ('s1', 'node-9', 'node-9', 'leader', true),
      ('s2', 'node-1', 'node-1', 'leader', true), ('s2', 'node-1', 'node-2', 'follower', true), ('s2', 'node-1', 'node-0', 'follower', true),
      ('s3', 'node-0', 'node-0', 'leader', true), ('s3', 'node-0', 'node-2', 'follower', true)) t(id, leader, node_id, role, healthy)""",
    "shard_drain": "SELECT * FROM (VALUES ('s1', 'node-1', true), ('s2', 'node-1', true), ('s3', 'node-2', true)) t(id, leader, drained)",
    "shard_drain_refused": "SELECT * FROM (VALUES ('s1', 'node-0', false), ('s2', 'node-1', false), ('s3', 'node-0', false), ('s9', 'node-0', false)) t(id, leader, drained)",
    "cluster_shards_b64": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{base64.b64encode(a.encode()).decode()}', '{base64.b64encode(b.encode()).decode()}', '{led}')" for n, a, b, led, _ in SHARDS) + ") t(id, start_b64, end_b64, leader)",
    "cdc_events": f"WITH {_EVENTS} SELECT * FROM ev",
    "cdc_page": f"WITH {_EVENTS} SELECT * FROM ev WHERE shard_id = 's1' AND \"offset\" > 500 ORDER BY \"offset\" LIMIT 20",
    "cdc_page_b64": f"WITH {_EVENTS} SELECT \"offset\", operation, base64(key::BLOB) AS key_b64, base64(value::BLOB) AS value_b64 FROM ev WHERE shard_id = 's2' AND \"offset\" > 100 ORDER BY \"offset\" LIMIT 10",
    "cdc_retention": f"WITH {_EVENTS}, {_KEPT} SELECT shard_id, \"offset\" FROM kept",
    "cdc_flags": f"WITH {_EVENTS}, {_KEPT}, {_flags('kept', 50, 100)} SELECT shard_id, {_FLAG_COLUMNS.format(after=50)} FROM f",
    "cdc_empty_shard": f"WITH {_EVENTS}, {_flags('ev', 12, 5)} SELECT s.id AS shard_id, {_FLAG_COLUMNS.format(after=12)} FROM (VALUES ('s1'), ('s2'), ('s3'), ('s4')) s(id) LEFT JOIN f ON f.shard_id = s.id",
    "cdc_limit_norm": "SELECT asked::BIGINT AS asked, (CASE WHEN asked <= 0 THEN 100 WHEN asked > 1000 THEN 1000 ELSE asked END)::BIGINT AS used FROM (VALUES (-5), (0), (1), (100), (1000), (1001), (5000)) t(asked)",
    "write_status_eviction": """WITH q AS (SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'committed' END AS state FROM orders),
      g AS (SELECT request_id, row_number() OVER (ORDER BY request_id) AS age FROM q WHERE state <> 'pending')
      SELECT state, count(*) AS kept, min(request_id) AS oldest FROM q WHERE request_id NOT IN (SELECT request_id FROM g WHERE age <= (SELECT count(*) // 5 FROM q)) GROUP BY state""",
    "engine_stats": f"""WITH {_runs()} SELECT (SELECT count(*) FROM m1) AS mutations, (SELECT max(seq) FROM m1) AS last_seq, (SELECT sum(CASE WHEN tombstone THEN 1 ELSE 0 END) FROM m1)::BIGINT AS deletes,
      count(DISTINCT run) AS runs, count(*) AS entries, sum({BYTES})::BIGINT AS bytes FROM r""",
    "stream_ingest_newest": f"WITH {M1} SELECT key, value, tombstone, seq FROM {_newest('m1')}",
    "stream_cdc": f"WITH {M1} SELECT seq AS \"offset\", 'default' AS shard_id, CASE WHEN tombstone THEN 'delete' ELSE 'put' END AS operation, key, value, tombstone FROM m1",
}
