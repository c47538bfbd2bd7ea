"""Streams into a store: each batch once, also after a restart."""

from tidelog.sources.store import ROW, Store
from tidelog.streaming import ingest


def test_restart_changes_nothing(spark, tmp_path):
    src = tmp_path / "in"
    store = Store(spark, f"file://{tmp_path}/store")
    seen = []
    spark.createDataFrame([(b"a", b"1", False, 1), (b"b", b"2", False, 2)], ROW).write.parquet(f"{src}/1")
    src_glob = spark.readStream.schema(ROW).option("recursiveFileLookup", True).parquet(str(src))
    run = lambda: ingest.into_store(src_glob, store, f"{tmp_path}/offsets", l0_threshold=2, on_commit=lambda i, s: seen.append(i)).awaitTermination()
    run()
    before = dict(store.manifest)
    run()
    assert store.manifest == before and seen == [0]
    spark.createDataFrame([(b"a", None, True, 3)], ROW).write.parquet(f"{src}/2")
    run()
    assert [r["key"] for r in store.scan().collect()] == [b"b"] and seen == [0, 1]
    assert [t.level for t in store.tables()] == [1]


def test_notices(spark):
    told = []
    n = ingest.Notices(lambda kind, what: told.append(kind), room=2)
    n._tell("started", 1)
    n._tell("progress", 2)
    n._tell("idle", 3)
    assert told == ["started", "progress", "idle"] and n.events == ["progress", "idle"]
    bad = ingest.Notices(lambda kind, what: 1 / 0)
    bad._tell("started", 1)
    assert bad.failed == 1
