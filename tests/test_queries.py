"""Every core query against its SQL, or for those without one a check of what it must hold."""

import pytest

from tests.conftest import SF, SF_LARGER
from tidelog.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, same, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["key", "value", "seq"]
    assert set(e.oracle_sql()) <= set(e.queries())


def plain_fnv(key: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in key:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_fnv_shard_counts(spark):
    want = {}
    for r in catalogue.get_newest_all(spark, SF).collect():
        k = r["key"].encode()
        n, size = want.get(plain_fnv(k) & 15, (0, 0))
        want[plain_fnv(k) & 15] = n + 1, size + len(k) + len((r["value"] or "").encode())
    assert {r["shard"]: (r["entries"], r["bytes"]) for r in catalogue.fnv_shard_counts(spark, SF).collect()} == want


def test_bloom_answers_as_plain_python(spark):
    """Misses and false answers of each run's filter, bit by bit."""
    from tidelog.operators import runs

    by = {}
    for r in runs.by_run(catalogue.m1(spark, SF)).select("run", "key").collect():
        by.setdefault(r["run"], []).append(r["key"])
    want = []
    for held_and_other in by.values():
        held, other = ([k for k in held_and_other if int(k[1:]) % 2 == odd] for odd in (0, 1))
        m, bits = max(64, len(held) * 10), set()
        places = lambda k, m=m: {(h + i * ((h >> 33) | 1)) % 2**64 % m for h in [plain_fnv(k.encode())] for i in range(6)}
        for k in held:
            bits |= places(k)
        want.append((len(held), 0, len(other), sum(places(k) <= bits for k in other)))
    assert sorted(tuple(r) for r in catalogue.bloom_probe(spark, SF).collect()) == sorted(want)


def test_blocks_as_plain_python(spark):
    from tidelog.operators import runs

    by, want = {}, []
    for r in runs.by_run(catalogue.m1(spark, SF)).select("run", "key", "value").collect():
        by.setdefault(r["run"], []).append((r["key"].encode(), (r["value"] or "").encode()))
    for run, rows in by.items():
        block, size = [], 0
        out = []
        for k, v in sorted(rows):
            shared = 0
            if len(block) % 16:
                while shared < min(len(k), len(block[-1])) and k[shared] == block[-1][shared]:
                    shared += 1
            block.append(k)
            size += 21 + len(k) - shared + len(v)
            if size > 2048:
                out.append((block, size))
                block, size = [], 0
        if block:
            out.append((block, size))
        want += [(run, i, len(b), b[0].decode(), b[-1].decode(), n + 4 * -(-len(b) // 16) + 4) for i, (b, n) in enumerate(out)]
    assert sorted(tuple(r) for r in catalogue.block_packing(spark, SF).collect()) == sorted(want)


def test_snapshot_bounds_reach_the_scan(spark):
    for name in ("snapshot_range", "snapshot_get_asof", "replay_tail"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(event_id), " in plan, plan


def test_change_flags_without_a_window(spark, same):
    """Equal offsets count one by one as in SQL, in more shards than an aggregate holds before it sorts (128); no shard is brought together."""
    from tidelog.operators import cdc

    ev = spark.range(0, 8000, 1, 4).selectExpr("id DIV 600 + id % 200 + 1 AS offset", "concat('s', id % 200) AS shard_id")
    sql = "WITH ev AS (SELECT id // 600 + id % 200 + 1 AS \"offset\", 's' || id % 200 AS shard_id FROM range(8000) r(id)), {} SELECT shard_id, {} FROM f"
    for after, limit in ((14, 5), (14, 100), (0, 1)):
        same(cdc.flags(ev, after, limit), sql.format(catalogue._flags("ev", after, limit), catalogue._FLAG_COLUMNS.format(after=after)))
    plan = catalogue.cdc_empty_shard(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan, plan


def test_overlap_pairs_of_all_runs(spark):
    runs = catalogue.meta(spark, SF_LARGER).select("path", "min_key", "max_key").collect()
    want = {(a[0], b[0]) for a in runs for b in runs if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2]}
    got = [tuple(r) for r in catalogue.overlap_pairs(spark, SF_LARGER).collect()]
    assert len(runs) == 10 and len(got) == len(want) and set(got) == want


def test_compaction_merges_all_runs(spark):
    from tidelog.operators import runs, versions

    rows = runs.by_run(catalogue.m1(spark, SF_LARGER)).select("run", "key", "seq").collect()
    assert max(r["run"] for r in rows) > catalogue.COMPACTED
    want = sorted(tuple(r) for r in versions.newest(catalogue.m1(spark, SF_LARGER)).select("key", "seq", "tombstone").collect())
    for name, expected in (("compaction_keep", want), ("compaction_drop", [w for w in want if not w[2]])):
        assert sorted(tuple(r) for r in catalogue.QUERIES[name](spark, SF_LARGER).select("key", "seq", "tombstone").collect()) == expected
    keys = [r["key"] for r in rows]
    assert {tuple(r) for r in catalogue.compaction_obsolete_versions(spark, SF_LARGER).collect()} == {(k, keys.count(k) - 1) for k in set(keys) if keys.count(k) > 1}
