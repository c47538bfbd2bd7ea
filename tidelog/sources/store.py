"""A store of sorted runs: Parquet runs, versioned manifests, snapshots, compaction, recovery.

Layout below ``root``: ``log/batch=N`` holds the mutations as they came (for
reads as of any sequence number), ``runs/NAME`` one key-sorted run each, and
``manifest/N.json`` what belongs to version N. The highest version that can be
read holds. A version's file is created, never replaced, so of two writers one
finds it taken and takes up its edit again on top of the other's. Readers trust
the manifest alone; a run without an entry is not seen. Keys and values are bytes.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, replace

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import defaults
from tidelog.operators import admission, runs, versions
from tidelog.operators.runs import Run
from tidelog.session import filesystem

ROW = "key binary, value binary, tombstone boolean, seq long"
#: What is done about a run that cannot be read when a store without a manifest is taken up.
FAIL, DROP = "fail-fast", "drop-table"


class StoreError(RuntimeError):
    pass


def as_bytes(key: str | bytes | None) -> bytes | None:
    return key.encode() if isinstance(key, str) else key


def literal(key: bytes) -> Column:
    return F.lit(bytearray(key))


class Snapshot:
    """The store as it was when the snapshot was taken. Its runs stay until it is closed."""

    def __init__(self, store: Store, runs_: list[Run], seq: int):
        self.store, self.runs, self.seq, self.closed = store, runs_, seq, False

    def get(self, key: str | bytes) -> DataFrame:
        return self.store._get(self.runs, as_bytes(key))

    def range(self, start: str | bytes | None = None, end: str | bytes | None = None) -> DataFrame:
        return self.store._scan(self.runs, as_bytes(start), as_bytes(end))

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.store.snapshots.remove(self)


class Store:
    """``on_corrupt`` says what to do about unreadable runs when the manifest is rebuilt: fail-fast or drop-table."""

    def __init__(self, spark: SparkSession, root: str, on_corrupt: str = FAIL):
        if on_corrupt not in (FAIL, DROP):
            raise ValueError(f"unknown policy {on_corrupt!r}")
        self.spark, self.root, self.on_corrupt = spark, root.rstrip("/"), on_corrupt
        self.snapshots: list[Snapshot] = []
        self.dropped: list[str] = []
        self.closed = False
        self.manifest = self._load()

    # --- manifest

    def _names(self, folder: str) -> list[str]:
        fs, at = filesystem(self.spark, f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, path: str) -> str:
        fs, at = filesystem(self.spark, path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.removesuffix(".json").isdigit())

    def _load(self) -> dict:
        """The newest manifest that is whole; a torn one at the end is passed over. Runs without statistics get them."""
        known = self._versions()
        for v in reversed(known):
            try:
                found = json.loads(self._read(f"{self.root}/manifest/{v:012d}.json"))
            except (ValueError, Py4JError):
                continue
            if v != known[-1] and {t["path"] for t in found["tables"]} - set(self._names("runs")):
                continue  # an older version whose runs are gone
            found["version"] = known[-1]
            bare = [t for t in found["tables"] if t.get("entry_count") is None]
            found["tables"] = [t if t.get("entry_count") is not None else asdict(self._stats(t["path"], t["level"])) for t in found["tables"]]
            return self._commit(lambda m: dict(found), found) if bare else found
        return self._rebuild()

    def _rebuild(self) -> dict:
        """A manifest from what is there: each batch of the log whose run is whole, on level 0.

        The log has every mutation that was committed, so merged runs, whose
        inputs may lie beside them, are not needed. Where there is no log all
        runs are taken up. A run that cannot be read fails the rebuild, or is dropped
        and its batch built again from the log.
        """
        batches = sorted(int(n.removeprefix("batch=")) for n in self._names("log") if n.startswith("batch=") and n.removeprefix("batch=").isdigit())
        names, tables, kept = self._names("runs"), [], []
        if not batches and not names:
            return {"version": 0, "wal_seq": 0, "batches": [], "tables": []}
        if batches:
            for b in batches:
                if not self._done(f"log/batch={b}"):
                    continue  # its writer did not come to the end, and will come again
                log = self.spark.read.schema(ROW).parquet(f"{self.root}/log/batch={b}")
                own = [n for n in names if n.split("-")[:2] == ["run", f"{b:06d}"] and self._done(f"runs/{n}")]
                found = next((m for n in own if (m := self._whole(n, 0)) is not None and m.entry_count), None)
                if found is None and self._whole(None, 0, log) is None:
                    continue
                if found is None:
                    found = self._write(versions.newest(log), self._fresh(f"run-{b:06d}"), 0)
                kept.append(b)
                if found.entry_count:
                    tables.append(asdict(found))
        else:
            tables = [asdict(m) for n in names if self._done(f"runs/{n}") and (m := self._whole(n, 0)) is not None and m.entry_count]
        out = {"wal_seq": max([0, *(t["seq_max"] for t in tables)]), "batches": kept, "tables": tables}
        return self._commit(lambda m: dict(m, **out), {"version": max([0, *self._versions()])})

    def _done(self, folder: str) -> bool:
        fs, at = filesystem(self.spark, f"{self.root}/{folder}/_SUCCESS")
        return fs.exists(at)

    def _whole(self, name: str | None, level: int, rows: DataFrame | None = None) -> Run | None:
        """The statistics of a run, or of the rows given, all columns read; none if it is dropped as corrupt."""
        try:
            have = self._rows(name) if rows is None else rows
            have.agg(F.sum(F.xxhash64("key", "value", "tombstone", "seq") % 7)).first()
            return self._stats(name, level) if rows is None else Run("", level, None, None, 0)
        except (PySparkException, Py4JError) as e:
            if self.on_corrupt == FAIL:
                raise StoreError(f"{name or 'a batch of the log'} cannot be read: {str(e)[:200]}") from e
            self.dropped.append(name or "log")
            return None

    def _commit(self, edit: Callable[[dict], dict], base: dict | None = None) -> dict:
        """Make ``edit`` of the newest manifest the next version. Where another writer was first the edit is made again on what it left."""
        have = base if base is not None else self.manifest
        while True:
            new = dict(edit(have), version=have["version"] + 1)
            if self._create(f"{self.root}/manifest/{new['version']:012d}.json", json.dumps(new)):
                self.manifest = new
                return new
            have = self._load()

    def _create(self, path: str, text: str) -> bool:
        """Write a file whole under a name that nobody has; false if the name is taken."""
        fs, tmp = filesystem(self.spark, f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(tmp), fs.makeQualified(filesystem(self.spark, path)[1]), options)
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def prune_manifests(self, keep: int = 16) -> None:
        """Remove all but the newest versions, which only a reader in the middle of a read could still need."""
        for v in self._versions()[:-keep]:
            fs, at = filesystem(self.spark, f"{self.root}/manifest/{v:012d}.json")
            fs.delete(at, False)

    def refresh(self) -> None:
        """Take up what other writers have committed."""
        self.manifest = self._load()

    def tables(self) -> list[Run]:
        return [_run(t) for t in self.manifest["tables"]]

    def _fresh(self, name: str) -> str:
        return f"{name}-{uuid.uuid4().hex[:8]}"

    def _stats(self, name: str, level: int) -> Run:
        r = self._rows(name).agg(
            F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.sum(runs.live_size()).alias("size"), F.count(F.lit(1)).alias("n")
        ).first()
        return Run(name, level, _text(r["lo"]), _text(r["hi"]), r["size"] or 0, r["a"] or 0, r["b"] or 0, r["n"])

    def _rows(self, *names: str) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(*[f"{self.root}/runs/{n}" for n in names])

    # --- writing

    def append(self, batch: DataFrame, batch_id: int) -> bool:
        """Take up a batch of mutations; false if it was taken up before. Invalid mutations go to ``rejected``.

        Keys and values may be strings or bytes. The log is written before the
        manifest names it and a run has a name of its own, so a batch that
        is repeated after a failure touches nothing that is in use.
        """
        if self.closed:
            raise StoreError("closed")
        if batch_id in self.manifest["batches"]:
            return False
        rows = batch.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "tombstone", "seq")
        ok, bad = admission.split_valid(admission.committed(rows))
        log = f"{self.root}/log/batch={batch_id}"
        ok.write.mode("overwrite").parquet(log)
        bad.write.mode("overwrite").parquet(f"{self.root}/rejected/batch={batch_id}")
        meta = self._write(versions.newest(self.spark.read.schema(ROW).parquet(log)), self._fresh(f"run-{batch_id:06d}"), 0)

        def edit(m: dict) -> dict:
            if batch_id in m["batches"]:
                raise StoreError(f"batch {batch_id} was taken up by another writer")
            new = dict(m, batches=[*m["batches"], batch_id])
            if meta.entry_count:
                new |= {"tables": [*m["tables"], asdict(meta)], "wal_seq": max(m["wal_seq"], meta.seq_max)}
            return new

        self._commit(edit)
        return True

    def next_batch(self) -> int:
        return max([-1, *self.manifest["batches"]]) + 1

    def _write(self, rows: DataFrame, name: str, level: int) -> Run:
        """One run: files of disjoint key ranges, sorted, with a Bloom filter on the key."""
        rows.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.root}/runs/{name}")
        return self._stats(name, level)

    # --- reading

    def _pruned(self, tables: list[Run], start: bytes | None, end: bytes | None, closed: bool = False) -> DataFrame:
        some = [t.path for t in tables if (not start or _bytes(t.max_key) >= start) and (not end or (_bytes(t.min_key) <= end if closed else _bytes(t.min_key) < end))]
        if not some or (start and end and start >= end and not closed):
            return self.spark.createDataFrame([], ROW)
        return self._rows(*some)

    def _get(self, tables: list[Run], key: bytes) -> DataFrame:
        new = versions.newest(self._pruned(tables, key, key, closed=True).filter(F.col("key") == literal(key)))
        return new.withColumn("found", ~F.col("tombstone"))

    def _scan(self, tables: list[Run], start: bytes | None, end: bytes | None) -> DataFrame:
        rows = self._pruned(tables, start, end)
        rows = rows.filter(F.col("key") >= literal(start)) if start else rows
        rows = rows.filter(F.col("key") < literal(end)) if end else rows
        return versions.scan(rows)

    def get(self, key: str | bytes) -> DataFrame:
        return self._get(self.tables(), as_bytes(key))

    def scan(self, start: str | bytes | None = None, end: str | bytes | None = None) -> DataFrame:
        return self._scan(self.tables(), as_bytes(start), as_bytes(end))

    def newest(self) -> DataFrame:
        return versions.newest(self._pruned(self.tables(), None, None))

    def log(self) -> DataFrame:
        """All mutations as they came."""
        if not self.manifest["batches"]:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*[f"{self.root}/log/batch={b}" for b in self.manifest["batches"]])

    def as_of(self, seq: int) -> DataFrame:
        """Live keys at a sequence number, from the log (merged runs have lost older versions)."""
        return versions.scan(versions.as_of(self.log(), seq))

    def snapshot(self) -> Snapshot:
        if self.closed:
            raise StoreError("closed")
        out = Snapshot(self, self.tables(), self.manifest["wal_seq"])
        self.snapshots.append(out)
        return out

    # --- upkeep

    def compact(self, l0_threshold: int, base_bytes: int = 0, multiplier: int = 10, drop_tombstones: bool = True) -> int:
        """Merge until no plan is left; the number of merges. Tombstones go only where nothing older lies deeper."""
        done = 0
        while (p := runs.plan([_keyed(t) for t in self.tables()], l0_threshold, base_bytes, multiplier)) is not None:
            tables = self.tables()
            drop = drop_tombstones and runs.may_drop([_keyed(t) for t in tables], p.inputs, p.output_level)
            meta = self._write(runs.merge(self._rows(*p.inputs), drop), self._fresh(f"merge-{self.manifest['version'] + 1:06d}"), p.output_level)

            def edit(m: dict, p=p, meta=meta) -> dict:
                gone = set(p.inputs) - {t["path"] for t in m["tables"]}
                if gone:
                    raise StoreError(f"another writer has merged {sorted(gone)}")
                return dict(m, tables=[t for t in m["tables"] if t["path"] not in p.inputs] + ([asdict(meta)] if meta.entry_count else []))

            self._commit(edit)
            done += 1
        return done

    def vacuum(self, trash_files: int | None = None, trash_bytes: int = defaults.TRASH_BYTES) -> list[str]:
        """Remove run folders that neither the manifest nor an open snapshot needs; the names of those that are gone.

        With ``trash_files`` the newest that many stay, while they are within ``trash_bytes`` together.
        """
        used = {t.path for t in self.tables()} | {t.path for s in self.snapshots for t in s.runs}
        fs, at = filesystem(self.spark, f"{self.root}/runs")
        loose = [(s.getModificationTime(), s.getPath().getName(), s.getPath()) for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName() not in used]
        kept: set[str] = set()
        if trash_files is not None:
            total = 0
            for _, name, path in sorted(loose, key=lambda x: x[:2], reverse=True)[:trash_files]:
                total += fs.getContentSummary(path).getLength()
                if total > trash_bytes:
                    break
                kept.add(name)
        gone = [(name, path) for _, name, path in loose if name not in kept]
        for _, path in gone:
            fs.delete(path, True)
        return sorted(name for name, _ in gone)

    def replay(self, log: DataFrame) -> bool:
        """Take up the part of a log above the checkpoint as one batch."""
        tail = log.filter(F.col("seq") > self.manifest["wal_seq"])
        return self.append(tail, self.next_batch()) if not tail.isEmpty() else False

    def stats(self) -> dict:
        t = self.tables()
        return {
            "version": self.manifest["version"], "wal_seq": self.manifest["wal_seq"], "batches": len(self.manifest["batches"]), "tables": len(t), "levels": len({x.level for x in t}),
            "entries": sum(x.entry_count for x in t), "bytes": sum(x.size_bytes for x in t), "snapshots": len(self.snapshots), "pinned": len({x.path for s in self.snapshots for x in s.runs}), "closed": self.closed,
        }

    def health(self) -> tuple[bool, str]:
        return (False, "closed") if self.closed else (True, "ok")

    def close(self) -> None:
        self.closed = True


def _text(key: bytes | None) -> str | None:
    """A key as it stands in the manifest."""
    return None if key is None else base64.b64encode(bytes(key)).decode()


def _bytes(key: str | None) -> bytes:
    return base64.b64decode(key or "")


def _run(t: dict) -> Run:
    return Run(**t)


def _keyed(t: Run) -> Run:
    """A run with its keys as text whose order is that of their bytes, for planning."""
    return replace(t, min_key=_bytes(t.min_key).decode("latin-1"), max_key=_bytes(t.max_key).decode("latin-1"))
