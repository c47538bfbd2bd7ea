"""Streams of mutations into a store, and change events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelog import model
from tidelog.operators import cdc
from tidelog.session import scratch
from tidelog.sources.store import Store


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of mutations (see ``model.event_log``)."""
    schema = model.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").option("maxFilesPerTrigger", 16).parquet(sf_dir)
    dead = F.col("event_type") == "error"
    return raw.select(F.format_string("u%06d", "user_id").alias("key"), F.when(~dead, F.col("props")).alias("value"), dead.alias("tombstone"), (F.col("event_id") + 1).alias("seq"))


def into_store(stream: DataFrame, store: Store, checkpoint: str, l0_threshold: int = 0, on_commit=None) -> StreamingQuery:
    """Each micro-batch is one run, committed under its number: a batch that is run again changes nothing.

    With a threshold the store is compacted after each batch until no plan is
    left. ``on_commit(batch_id, store)`` is called after a batch is in.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        if store.append(batch, batch_id):
            store.compact(l0_threshold)
            if on_commit is not None:
                on_commit(batch_id, store)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Notices(StreamingQueryListener):
    """Progress of streams as events for a callback; the callback's errors are counted and do not stop a stream."""

    def __init__(self, call, room: int = 16):
        self.call, self.room, self.failed, self.events = call, room, 0, []

    def _tell(self, kind: str, what) -> None:
        self.events = [*self.events, kind][-self.room :]
        try:
            self.call(kind, what)
        except Exception:
            self.failed += 1

    def onQueryStarted(self, event) -> None:
        self._tell("started", event.id)

    def onQueryProgress(self, event) -> None:
        self._tell("progress", event.progress)

    def onQueryIdle(self, event) -> None:
        self._tell("idle", event.id)

    def onQueryTerminated(self, event) -> None:
        self._tell("terminated", event.id)


def stream_ingest_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "store")
    store = Store(spark, f"{root}/store")
    into_store(event_stream(spark, sf_dir), store, f"{root}/offsets").awaitTermination()
    return store.newest().withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


def stream_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "changes")
    out = cdc.events(event_stream(spark, sf_dir))
    out.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/events")
