"""Newest versions, ranges, snapshots and merges on small logs, and a random model of the store."""

import random

import pytest

from tidelog.operators import admission, runs, versions
from tidelog.operators.runs import Run
from tidelog.sources.store import Store, StoreError


def log(spark, *rows):
    return spark.createDataFrame([(k, v, v is None, s) for k, v, s in rows], "key string, value string, tombstone boolean, seq long")


def keys(df):
    return [r["key"] if isinstance(r["key"], str) else bytes(r["key"]).decode() for r in df.collect()]


def test_tombstone_is_returned_but_not_found(spark):
    r = versions.get(log(spark, ("alpha", "one", 1), ("alpha", None, 2)), ["alpha"]).first()
    assert r["tombstone"] and not r["found"]


@pytest.mark.parametrize(("start", "end", "want"), [("b", "d", ["b", "c"]), (None, None, ["a", "b", "c", "d"]), ("x", "z", []), ("d", "b", []), ("c", None, ["c", "d"]), (None, "b", ["a"])])
def test_ranges(spark, start, end, want):
    assert keys(versions.scan(log(spark, ("b", "2", 1), ("a", "1", 2), ("d", "4", 3), ("c", "3", 4)), start, end)) == want


def test_merge_of_runs(spark):
    rows = log(spark, ("a", "old", 1), ("b", "one", 1), ("a", "new", 3), ("c", "two", 2))
    assert {r["key"]: r["value"] for r in runs.merge(rows).collect()} == {"a": "new", "b": "one", "c": "two"}
    assert runs.merge(log(spark, ("a", "old", 1), ("a", None, 2)), drop_tombstones=True).isEmpty()
    r = runs.merge(log(spark, ("k", "old", 1), ("k", "mid", 2), ("k", None, 3))).first()
    assert r["tombstone"] and r["seq"] == 3


def test_tie_goes_to_the_tombstone(spark):
    assert versions.newest(log(spark, ("k", "v", 5), ("k", None, 5))).first()["tombstone"]


def test_live_size(spark):
    size = lambda *rows: sum(r["n"] for r in versions.newest(log(spark, *rows)).select(runs.live_size().alias("n")).collect())
    assert size(("a", "1", 1)) == 2
    assert size(("a", "1", 1), ("a", "123", 2)) == 4
    assert size(("a", "1", 1), ("a", None, 2)) == 1


def test_rejects(spark):
    rows = spark.createDataFrame([("", "v", False, 1), ("k", "", False, 2), ("", None, True, 3), ("k", None, True, 4), ("k", "v" * 100, False, 5), (None, "v", False, 6)], "key string, value string, tombstone boolean, seq long")
    ok, bad = admission.split_valid(rows, 64)
    assert keys(ok) == ["k"] and ok.first()["seq"] == 4
    assert {r["seq"]: r["code"] for r in bad.collect()} == {1: "empty_key", 2: "empty_value", 3: "empty_key", 5: "record_too_large", 6: "empty_key"}


def test_plans():
    r = lambda path, level, lo, hi, size=0: Run(path, level, lo, hi, size)
    p = runs.plan([r("l0a", 0, "a", "c"), r("l1a", 1, "b", "d"), r("l1b", 1, "e", "f")], 1, 0)
    assert p.inputs == ["l0a", "l1a"] and p.output_level == 1
    p = runs.plan([r("l1a", 1, "a", "b", 8), r("l1b", 1, "c", "d", 8), r("l2a", 2, "b", "c")], 5, 10, 10)
    assert p.inputs == ["l1a", "l1b", "l2a"] and p.output_level == 2
    assert runs.plan([r("l0a", 0, "a", "c")], 0, 10) is None
    assert runs.plan([r("l2a", 2, "a", "c", 10**9)], 5, 1) is None  # levels are looked at up to the first gap
    assert runs.meets(r("x", 0, "", "b"), r("y", 0, "z", "zz"))


def test_safe_drop():
    tables = [Run("a", 0, "a", "c"), Run("b", 1, "b", "d"), Run("deep", 2, "c", "z")]
    assert not runs.may_drop(tables, ["a", "b"], 1)
    assert runs.may_drop(tables[:2], ["a", "b"], 1)


def test_snapshot_survives_compaction_and_vacuum(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(log(spark, ("k", "v1", 1), ("x", "x1", 2)), 0)
    snap = store.snapshot()
    store.append(log(spark, ("k", "v2", 3), ("x", None, 4), ("y", "y1", 5)), 1)
    assert store.compact(2) == 1
    store.vacuum()
    assert [(r["key"], r["value"]) for r in snap.range().collect()] == [(b"k", b"v1"), (b"x", b"x1")]
    assert snap.get("y").isEmpty() and snap.get("k").first()["value"] == b"v1"
    assert keys(store.scan()) == ["k", "y"] and store.get("x").isEmpty()
    snap.close()
    snap.close()
    assert [n[:10] for n in store.vacuum()] == ["run-000000"]  # the other run went before, as no snapshot held it
    assert [(r["key"], r["value"]) for r in store.as_of(2).collect()] == [(b"k", b"v1"), (b"x", b"x1")]
    again = Store(spark, f"file://{tmp_path}/s")
    assert keys(again.scan()) == ["k", "y"] and again.manifest["wal_seq"] == 5


def test_batch_is_taken_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.append(log(spark, ("a", "1", 1)), 7)
    before = dict(store.manifest)
    assert not store.append(log(spark, ("a", "2", 2)), 7)
    assert store.manifest == before


def test_rebuild_without_a_manifest(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(log(spark, ("a", "1", 1), ("b", "2", 2)), 0)
    store.append(log(spark, ("b", None, 3)), 1)
    store.compact(2, drop_tombstones=False)
    store.vacuum()
    for torn in (False, True):
        for f in (tmp_path / "s" / "manifest").iterdir():
            if torn and f.name.endswith(".json"):
                f.write_text("{torn")
            else:
                f.unlink()
        again = Store(spark, f"file://{tmp_path}/s")
        assert again.manifest["wal_seq"] == 3 and {t.level for t in again.tables()} == {0} and again.manifest["batches"] == [0, 1]
        assert keys(again.scan()) == ["a"]
    # what comes after a rebuild takes nothing away
    assert again.replay(log(spark, ("d", "4", 4))) and keys(again.scan()) == ["a", "d"]
    assert [(r["key"], bytes(r["value"])) for r in again.as_of(2).collect()] == [(b"a", b"1"), (b"b", b"2")]
    assert len({t.path for t in again.tables()}) == len(again.tables()) and not again.append(log(spark, ("x", "y", 9)), 1)


def test_torn_manifest_at_the_end_is_passed_over(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(log(spark, ("a", "1", 1)), 0)
    store.append(log(spark, ("b", "2", 2)), 1)
    last = max((tmp_path / "s" / "manifest").glob("*.json"))
    last.write_text(last.read_text()[:20])
    again = Store(spark, f"file://{tmp_path}/s")
    assert keys(again.scan()) == ["a"] and again.append(log(spark, ("b", "2", 2)), 1) and keys(again.scan()) == ["a", "b"]


def test_two_writers_lose_no_edit(spark, tmp_path):
    one, two = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    one.append(log(spark, ("a", "1", 1)), 0)
    two.append(log(spark, ("b", "2", 2)), 1)
    one.append(log(spark, ("c", "3", 3)), 2)
    with pytest.raises(StoreError):
        two.append(log(spark, ("x", "3", 3)), 2)
    for s in (one, Store(spark, f"file://{tmp_path}/s")):
        s.refresh()
        assert keys(s.scan()) == ["a", "b", "c"] and s.manifest["wal_seq"] == 3


def test_corrupt_runs_at_a_rebuild(spark, tmp_path):
    import shutil

    store = Store(spark, f"file://{tmp_path}/s")
    store.append(log(spark, ("a", "1", 1)), 0)
    store.append(log(spark, ("b", "2", 2)), 1)
    bad = store.tables()[1].path
    for f in (tmp_path / "s" / "runs" / bad).iterdir():
        if f.name.endswith(".crc"):
            f.unlink()
        elif f.suffix == ".parquet":
            f.write_bytes(b"PAR1 not a run PAR1")
    shutil.rmtree(tmp_path / "s" / "manifest")
    with pytest.raises(StoreError):
        Store(spark, f"file://{tmp_path}/s")
    again = Store(spark, f"file://{tmp_path}/s", on_corrupt="drop-table")
    assert again.dropped == [bad] and keys(again.scan()) == ["a", "b"]  # the batch was built again from the log
    shutil.rmtree(tmp_path / "s" / "manifest")
    shutil.rmtree(tmp_path / "s" / "log")
    assert keys(Store(spark, f"file://{tmp_path}/s", on_corrupt="drop-table").scan()) == ["a", "b"]


def test_missing_statistics_are_made_up(spark, tmp_path):
    import json

    store = Store(spark, f"file://{tmp_path}/s")
    store.append(log(spark, ("a", "1", 1)), 0)
    last = max((tmp_path / "s" / "manifest").glob("*.json"))
    bare = json.loads(last.read_text())
    bare["tables"] = [{"path": t["path"], "level": 0} for t in bare["tables"]]
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    last.write_text(json.dumps(bare))
    again = Store(spark, f"file://{tmp_path}/s")
    assert again.tables() == store.tables() and again.manifest["version"] == 2


def test_any_bytes_are_keys_and_values(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = [(b"\xff\xfe", b"\x00\x80", False, 1), (b"\x00", b"v", False, 2), (b"a", b"w", False, 3)]
    store.append(spark.createDataFrame(rows, "key binary, value binary, tombstone boolean, seq long"), 0)
    assert bytes(store.get(b"\xff\xfe").first()["value"]) == b"\x00\x80"
    assert [bytes(r["key"]) for r in store.scan(b"\x00", b"\xff").collect()] == [b"\x00", b"a"]
    store.append(spark.createDataFrame([(b"\xff\xfe", None, True, 4)], "key binary, value binary, tombstone boolean, seq long"), 1)
    assert store.compact(2) == 1 and [bytes(r["key"]) for r in store.scan().collect()] == [b"\x00", b"a"]


def test_trash_keeps_the_newest(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for i in range(3):
        store.append(log(spark, (f"k{i}", "v", i + 1)), i)
    store.compact(3)
    assert len(store.vacuum(trash_files=1)) == 2 and len(store.vacuum(trash_files=1, trash_bytes=1)) == 1 and keys(store.scan()) == ["k0", "k1", "k2"]


def test_replay_takes_only_the_tail(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(log(spark, ("a", "1", 1)), 0)
    assert store.replay(log(spark, ("a", "0", 1), ("b", "2", 2), ("c", "3", 3)))
    assert store.stats()["entries"] == 3 and not store.replay(log(spark, ("a", "0", 1)))
    store.close()
    assert store.health() == (False, "closed")
    with pytest.raises(StoreError):
        store.append(log(spark, ("z", "9", 9)), 9)
    with pytest.raises(StoreError):
        store.snapshot()


def test_random_model(spark, tmp_path):
    """Random batches, merges and snapshots against a dictionary of versions."""
    rng, store, seq, model, snaps = random.Random(5), Store(spark, f"file://{tmp_path}/m"), 0, {}, []
    for batch in range(7):
        rows = []
        for _ in range(rng.randint(1, 12)):
            seq += 1
            k, dead = f"k{rng.randint(0, 9)}", rng.random() < 0.3
            v = None if dead else f"v{seq}"
            rows.append((k, v, seq))
            model[k] = v
        store.append(log(spark, *rows), batch)
        if rng.random() < 0.5:
            store.compact(rng.randint(1, 3), 40)
        if rng.random() < 0.4:
            snaps.append((store.snapshot(), dict(model)))
        store.vacuum()
        live = {k: v for k, v in model.items() if v is not None}
        assert {r["key"].decode(): r["value"].decode() for r in store.scan().collect()} == live
    for snap, state in snaps:
        assert {r["key"].decode(): r["value"].decode() for r in snap.range("k2", "k8").collect()} == {k: v for k, v in state.items() if v is not None and "k2" <= k < "k8"}
