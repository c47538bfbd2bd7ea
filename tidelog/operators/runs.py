"""Sorted runs: statistics, pruning, levels, merge plans and merging."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import defaults
from tidelog.operators import versions


def live_size() -> Column:
    """Bytes of keys and values; a tombstone has its key's alone."""
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))


def by_run(log: DataFrame, every: int = 1000) -> DataFrame:
    """The log cut into runs of ``every`` sequence numbers, one version of a key in each."""
    return versions.newest(log.withColumn("run", F.floor((F.col("seq") - 1) / every).cast("long")), ["run", "key"])


def path_of(run: Column) -> Column:
    return F.concat(F.lit("run-"), F.lpad(run.cast("string"), 6, "0"))


def metadata(rows: DataFrame, level: Column | None = None) -> DataFrame:
    """One row of statistics a run; ``rows`` are one version of each key by ``run``."""
    return (
        rows.groupBy("run")
        .agg(
            F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("seq_min"), F.max("seq").alias("seq_max"),
            F.sum(live_size()).cast("long").alias("size_bytes"), F.count(F.lit(1)).alias("entry_count"),
        )
        .select(path_of(F.col("run")).alias("path"), (level if level is not None else F.lit(0)).cast("int").alias("level"), "min_key", "max_key", "seq_min", "seq_max", "size_bytes", "entry_count")
    )


def prune_key(meta: DataFrame, key) -> DataFrame:
    """Runs whose closed key range may hold ``key``."""
    return meta.filter((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))


def prune_range(meta: DataFrame, start=None, end=None) -> DataFrame:
    """Runs that may hold keys of [start, end)."""
    ok = F.lit(True)
    if start:
        ok = ok & (F.col("max_key") >= F.lit(start))
    if end:
        ok = ok & (F.col("min_key") < F.lit(end))
    return meta.filter(ok)


def registry_order(meta: DataFrame) -> DataFrame:
    """Position of each run in lookups: the newest first, paths ascending where they tie."""
    return meta.withColumn("position", F.row_number().over(Window.orderBy(F.desc("seq_max"), "path")).cast("long"))


def level_state(meta: DataFrame) -> DataFrame:
    return meta.groupBy("level").agg(F.count(F.lit(1)).alias("runs"), F.sum("size_bytes").cast("long").alias("size_bytes"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def overlaps(a: str, b: str) -> Column:
    """Closed key ranges of two aliased runs meet; a run with an open bound meets all."""
    bounds = [F.col(f"{x}.{c}") for x in (a, b) for c in ("min_key", "max_key")]
    unbounded = F.lit(False)
    for c in bounds:
        unbounded = unbounded | c.isNull() | (F.length(c) == 0)
    return unbounded | ((bounds[0] <= bounds[3]) & (bounds[2] <= bounds[1]))


@dataclass
class Run:
    path: str
    level: int
    min_key: bytes | str | None
    max_key: bytes | str | None
    size_bytes: int = 0
    seq_min: int = 0
    seq_max: int = 0
    entry_count: int = 0


@dataclass
class Plan:
    inputs: list[str] = field(default_factory=list)
    output_level: int = 0
    reason: str = ""


def meets(a: Run, b: Run) -> bool:
    if not all((a.min_key, a.max_key, b.min_key, b.max_key)):
        return True
    return a.min_key <= b.max_key and b.min_key <= a.max_key


def plan(runs: list[Run], l0_threshold: int, base_bytes: int, multiplier: int = defaults.LEVEL_MULTIPLIER) -> Plan | None:
    """The next compaction, or none.

    Level 0 merges into level 1 when it holds ``l0_threshold`` runs; level n
    merges into n + 1 when it is larger than base * multiplier ** (n - 1).
    Runs of the next level come along where their keys overlap. Levels are
    looked at in turn up to the first that is empty. A threshold of zero or
    less turns compaction off. Metadata of runs is small by design, so this is
    plain Python; ``plans.catalogue`` has the same rules as queries.
    """
    if l0_threshold <= 0:
        return None
    multiplier = multiplier if multiplier > 0 else defaults.LEVEL_MULTIPLIER
    at: dict[int, list[Run]] = {}
    for r in runs:
        at.setdefault(r.level, []).append(r)

    def chosen(level: int, reason: str) -> Plan:
        own = at[level]
        more = [x for x in at.get(level + 1, []) if any(meets(x, y) for y in own)]
        return Plan(list(dict.fromkeys(x.path for x in [*own, *more])), level + 1, reason)

    if len(at.get(0, [])) >= l0_threshold:
        return chosen(0, "l0_count")
    level = 1
    while level in at:
        if base_bytes > 0 and sum(x.size_bytes for x in at[level]) > base_bytes * multiplier ** (level - 1):
            return chosen(level, "level_size")
        level += 1
    return None


def merge(rows: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """One version of each key from the rows of several runs."""
    out = versions.newest(rows)
    return out.filter(~F.col("tombstone")) if drop_tombstones else out


def may_drop(runs: list[Run], inputs: list[str], output_level: int) -> bool:
    """Whether no run outside the merge lies deeper and overlaps it, so that no older version can come back."""
    own = [r for r in runs if r.path in inputs]
    return not any(r.level >= output_level and r.path not in inputs and any(meets(r, x) for x in own) for r in runs)


def merge_manifest(tables: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Tables after an edit: removed paths go, an added path replaces its namesake."""
    gone = removed.select("path").unionByName(added.select("path")).distinct()
    return tables.join(gone, "path", "left_anti").unionByName(added)


def trash_kept(files: DataFrame, max_files: int = defaults.TRASH_FILES, max_bytes: int = defaults.TRASH_BYTES) -> DataFrame:
    """Files that stay when the oldest go until both the count and the bytes fit.

    A file stays if it and all newer ones fit. The running totals of a folder
    under retention are bounded by what one node keeps in it.
    """
    newest = Window.orderBy(F.desc("mtime"), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0)
    totals = files.withColumn("rank", F.count(F.lit(1)).over(newest)).withColumn("total", F.sum("size").over(newest).cast("long"))
    return totals.filter((F.col("rank") <= max_files) & (F.col("total") <= max_bytes))
