"""Structured Streaming forms: deduplication, sessions, keyed histories, table upserts and window metrics.

Streams carry event time ``ts`` (a timestamp) and a watermark that bounds their state. Table upserts
go through ``foreachBatch`` into buckets of a hash of their keys, with the batch id in the path: a batch
rewrites the buckets that it touches, and one that runs again writes the same rows.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evidex.operators.graph import shared_folder


def file_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The files of a table as a stream, with ``ts`` cast to a timestamp."""
    path = f"{sf_dir}/{table}.[p]arquet"  # a glob of this one name
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def dedupe_ingest(stream: DataFrame, keys: list[str], watermark: str = "1 hour") -> DataFrame:
    """The first arrival of each key within the watermark is kept."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def session_windows(stream: DataFrame, key: str, gap: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """(key, start, end, n): sessions that end after ``gap`` without an event."""
    rows = stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Sessions(StatefulProcessor):
    """The open sessions of a key: first and last event and number, as a list of hardly ever more than one.

    Events join the sessions that they lie within a gap of, and may so make two into one. A key has one
    timer, at the end of its first session. When the watermark has passed that, all sessions that are over
    are emitted at once and dropped from the state, so timers grow with keys and not with sessions.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def _held(self) -> list[tuple[int, int, int]]:
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def _end(self, session: tuple[int, int, int]) -> int:
        return -(-(session[1] + self.gap) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held = self._held()
        before = self._end(held[0]) if held else None
        for part in rows:
            merged: list[tuple[int, int, int]] = []
            for first, last, n in sorted([*held, *[(t, t, 1) for t in part["at"].tolist()]]):
                if merged and first < merged[-1][1] + self.gap:
                    a, b, m = merged[-1]
                    merged[-1] = a, max(b, last), m + n
                else:
                    merged.append((first, last, n))
            held = merged
        if self._end(held[0]) != before:
            for t in list(self.handle.listTimers()) if before is not None else ():
                self.handle.deleteTimer(t if isinstance(t, int) else t[0])
            self.handle.registerTimer(self._end(held[0]))
        self.open.put(held)
        yield pd.DataFrame({"key": [], "start": [], "end": [], "n": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000, self._held()
        done = [x for x in held if x[1] + self.gap <= now]
        left = [x for x in held if x[1] + self.gap > now]
        if left:
            self.open.put(left)
            self.handle.registerTimer(self._end(left[0]))
        else:
            self.open.clear()
        yield pd.DataFrame({"key": [key[0]] * len(done), "start": [x[0] for x in done], "end": [x[1] + self.gap for x in done], "n": [x[2] for x in done]}).astype("int64")

    def close(self) -> None:
        pass


def closed_sessions(stream: DataFrame, key: str, gap_seconds: int = 3600, watermark: str = "1 hour") -> DataFrame:
    """(key, start, end, n; start and end in microseconds): each session of a key, once, when it is over.

    State holds the sessions that are still open, and nothing else. Rows later than the watermark are
    dropped. Needs the RocksDB state store.
    """
    rows = stream.withWatermark("ts", watermark).select(F.col(key).cast("long").alias("key"), F.unix_micros("ts").alias("at"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(Sessions(gap_seconds * 1_000_000), "key long, start long, end long, n long", "Append", "eventTime")


def run_sessions(stream: DataFrame, key: str, gap_seconds: int = 3600, watermark: str = "1 hour", path: str | None = None) -> DataFrame:
    """Drains a stream of events into closed sessions, and reads them with those that are still open.

    Closed ones are appended to a table of ``path`` and gone from the state; open ones are read from the
    state itself, and a later run over the same path goes on with them.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    sessions = closed_sessions(stream, key, gap_seconds, watermark)
    with rocksdb(spark):
        q = sessions.writeStream.outputMode("append").format("parquet").option("path", f"{path}/closed").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        closed = spark.read.schema(sessions.schema).parquet(f"{path}/closed")
        return closed.unionByName(open_sessions(spark, path, gap_seconds))


def open_sessions(spark: SparkSession, path: str, gap_seconds: int) -> DataFrame:
    """The sessions that the state at ``path`` holds."""
    held = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", "open").load()
    return held.select(F.col("key.key").alias("key"), F.col("list_element").alias("x")).select("key", F.col("x.first").alias("start"), (F.col("x.last") + gap_seconds * 1_000_000).alias("end"), F.col("x.n").alias("n"))


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """The state store that arbitrary state needs, for the queries that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def component_metrics(stream: DataFrame, window: str = "1 day", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Requests, failures and mean latency of each component by window, tumbling or sliding."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = stream.withWatermark("ts", watermark).groupBy(w.alias("w"), "component").agg(F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("failures"), F.avg("latency").alias("mean_latency"))
    return rows.select(F.col("w.start").alias("start"), "component", "requests", "failures", "mean_latency")


class LastN(StatefulProcessor):
    """Keeps the newest ``n`` events of a key in list state, with expiry; emits the list's size and its newest event."""

    def __init__(self, n: int, ttl_ms: int):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "at long, id long", ttlDurationMs=self.ttl_ms) if self.ttl_ms else handle.getListState("ring", "at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        for part in rows:  # merged batch by batch, so memory holds n events and one batch
            held = sorted([*held, *zip(part["at"].tolist(), part["id"].tolist())])[-self.n :]
        self.ring.put(held)
        yield pd.DataFrame({"key": [key[0]], "kept": [len(held)], "oldest": [held[0][1]], "newest": [held[-1][1]]})

    def close(self) -> None:
        pass


def last_n(stream: DataFrame, key: str, event_id: str, n: int = 200, ttl_ms: int = 0) -> DataFrame:
    """(key, kept, oldest, newest) whenever a key has new events. Needs the RocksDB state store."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.unix_micros("ts").alias("at"), F.col(event_id).cast("long").alias("id"))
    return rows.groupBy("key").transformWithStateInPandas(LastN(n, ttl_ms), "key long, kept long, oldest long, newest long", "Update", "processingTime" if ttl_ms else "None")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain an append stream of files into a table of the shared folder, and read it."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_complete(stream: DataFrame) -> DataFrame:
    """Drain a stream of aggregates, open windows too: each batch writes all of them, and the last table is read."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/complete-{uuid.uuid4().hex}"
    last = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.parquet(f"{path}/v{batch_id}", mode="overwrite")
        delete(batch.sparkSession, f"{path}/v{batch_id - 2}")
        last["version"] = batch_id

    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/v{last['version']}") if last else spark.createDataFrame([], stream.schema)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def upsert(stream: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append", buckets: int = 16, path: str | None = None, **trigger) -> DataFrame:
    """Fold a stream into a table of rows by ``keys``, and read it.

    ``prepare`` turns a batch into the table's rows, each key once; ``merge(held, new)`` joins them with
    the rows of the same buckets. Rows are in one of ``buckets`` by a hash of their keys. A batch reads
    and rewrites only the buckets of its rows, in a folder of its own, and then writes which folder
    holds each bucket; a batch that runs again starts from the list before it. Buckets that the last
    list but one no longer names are deleted. A ``path`` from before is gone on with. ``trigger`` is
    availableNow unless given; state with expiry never runs out of batches and needs another.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    trigger = trigger or {"availableNow": True}
    last = {"version": -1}

    def listed(session: SparkSession, version: int) -> dict[int, int]:
        return {} if version < 0 else {r.bucket: r.version for r in session.read.schema("bucket int, version long").json(f"{path}/list/v{version}").collect()}

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = (prepare(batch) if prepare else batch).withColumn("bucket", bucket).persist()
        try:
            before = listed(session, batch_id - 1)
            touched = {r.bucket for r in fresh.select("bucket").distinct().collect()}  # ``buckets`` rows at most
            old = [f"{path}/v{before[b]}/bucket={b}" for b in sorted(touched & before.keys())]
            rows = merge(session.read.parquet(*old), fresh.drop("bucket")).withColumn("bucket", bucket) if old else fresh
            rows.write.partitionBy("bucket").parquet(f"{path}/v{batch_id}", mode="overwrite")
            now = before | dict.fromkeys(touched, batch_id)
            session.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.json(f"{path}/list/v{batch_id}", mode="overwrite")
            for b, version in listed(session, batch_id - 2).items():
                if before.get(b) != version:
                    delete(session, f"{path}/v{version}/bucket={b}")
        finally:
            fresh.unpersist()
        last["version"] = batch_id

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(**trigger).start()
    q.awaitTermination()
    paths = [f"{path}/v{version}/bucket={b}" for b, version in sorted(listed(spark, last["version"]).items())]
    if paths:
        return spark.read.parquet(*paths)
    none = spark.createDataFrame([], stream.schema)
    return prepare(none) if prepare else none


def merge_graph(held: DataFrame, new: DataFrame) -> DataFrame:
    """Edge tables as one; a source list would grow without bound, so edges carry none."""
    from evidex.operators import graph as G

    return G.merge_edges(held, new)


def graph_rows(batch: DataFrame) -> DataFrame:
    """The edges of a batch of relations."""
    from evidex.operators import graph as G

    return G.build_edges(batch).drop("n_sources")


def new_only(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Held rows, and new ones whose key is not among them."""
    return lambda held, new: held.unionByName(new.join(held.select(*keys), keys, "left_anti"))


def replace(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """New rows, and held ones whose key is not among them."""
    return lambda held, new: new.unionByName(held.join(new.select(*keys), keys, "left_anti"))
