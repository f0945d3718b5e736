"""Structured Streaming pipelines over the batch operators; each takes a stream and starts a query."""

from __future__ import annotations

import itertools
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from msgflow.functions.mime import effective, is_authorized
from msgflow.operators.moderation import censor
from msgflow.operators.monitor import GHOST_AFTER_S
from msgflow.operators.paging import next_batch
from msgflow.operators.validate import MAX_CONTENT_BYTES, check_requests, content_fits

Sink = Callable[[DataFrame, int], None]


def _start(df: DataFrame, sink: Sink, checkpoint: str, every: str | None) -> StreamingQuery:
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def parquet_sink(path: str, *partition_by: str) -> Sink:
    """Adds every batch as a partition ``batch`` of one table, so a batch that is run again replaces itself and readers see a plain table."""

    def write(batch: DataFrame, number: int) -> None:
        w = batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        w.partitionBy("batch", *partition_by).parquet(path)

    return write


class BufferedSink:
    """Hands rows on when ``rows`` of them are there, or ``seconds`` after the first one; ``close`` hands on the rest."""

    def __init__(self, flush: Callable[[list], None], rows: int = 500, seconds: float = 0.5):
        self._flush, self._rows, self._seconds = flush, rows, seconds
        self._held: list = []
        self._since = 0.0
        self._lock = threading.Lock()

    def _swap(self) -> list:
        held, self._held = self._held, []
        return held

    def consume(self, row) -> None:
        with self._lock:
            if not self._held:
                self._since = time.monotonic()
            self._held.append(row)
            due = self._swap() if len(self._held) >= self._rows else []
        if due:
            self._flush(due)

    def tick(self) -> None:
        """To be called between batches: time may be up."""
        with self._lock:
            due = self._swap() if self._held and time.monotonic() - self._since >= self._seconds else []
        if due:
            self._flush(due)

    def close(self) -> None:
        with self._lock:
            due = self._swap()
        if due:
            self._flush(due)

    def __call__(self, batch: DataFrame, number: int) -> None:
        for row in batch.toLocalIterator():
            self.consume(row)
        self.tick()


def route_by_type(routes: dict[str, Sink], telemetry: Sink | None = None, kind: str = "payload_type", on_lost: Callable[[Exception], None] | None = None) -> Sink:
    """Rows of each type to its sink; all rows to telemetry as well, whose failure stops nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, sink in routes.items():
                sink(batch.filter(F.col(kind) == name), number)
            if telemetry:
                try:
                    telemetry(batch, number)
                except Exception as error:
                    if on_lost:
                        on_lost(error)
        finally:
            batch.unpersist()

    return write


def to_all(*sinks: Sink) -> Sink:
    """One batch to several sinks, computed once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for s in sinks:
                s(batch, number)
        finally:
            batch.unpersist()

    return write


def moderate(messages: DataFrame, patterns: list[str], limit: int = MAX_CONTENT_BYTES) -> DataFrame:
    """Messages that fit, sanitized: the same in batch and stream."""
    fits = messages.filter(content_fits(F.col("content"), limit))
    return censor(fits, patterns).withColumn("content", F.col("sanitized")).drop("sanitized")


def start_moderation(messages: DataFrame, patterns: list[str], sink: Sink, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return _start(moderate(messages, patterns), sink, checkpoint, every)


def ingest(requests: DataFrame) -> DataFrame:
    """Valid file requests with their effective type and whether they make a task."""
    ok = check_requests(requests).filter(F.size("reasons") == 0).drop("reasons")
    return ok.withColumn("effective_mime_type", effective(F.col("mime_type"))).withColumn("makes_task", is_authorized(F.col("mime_type")))


def start_ingest(requests: DataFrame, records: Sink, tasks: Sink, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Records of all valid files, and tasks for those of authorised types."""
    return _start(ingest(requests), to_all(records, lambda b, n: tasks(b.filter("makes_task"), n)), checkpoint, every)


def rates(events: DataFrame, at: str, value: str, window: str = "1 second", late: str = "1 minute") -> DataFrame:
    """``window_start, n, total`` per tumbling window of event time."""
    w = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "n", "total")


def sessions(reports: DataFrame, at: str = "reported_at", gap: str = "15 seconds", late: str = "1 hour") -> DataFrame:
    """Stretches in which a node kept reporting."""
    w = reports.withWatermark(at, late).groupBy("node_id", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n_reports"))
    return w.select("node_id", F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "n_reports")


def start_queue(spark: SparkSession, tasks: Callable[[], DataFrame], mark: Callable[[DataFrame, int], None], dispatch: Sink, checkpoint: str, n: int = 5, every: str = "1 second") -> StreamingQuery:
    """At every tick the next ``n`` pending tasks are marked, then dispatched; the next tick waits for that."""

    def tick(_: DataFrame, number: int) -> None:
        chosen = next_batch(tasks(), n).collect()  # n rows
        if chosen:
            batch = spark.createDataFrame(chosen)
            mark(batch, number)
            dispatch(batch, number)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


JOB_STATE = "state string, created_at_ns long"


def track_jobs(log: DataFrame) -> DataFrame:
    """Stream of job events ``file_id, event, at_ns`` (add, run, remove) -> ``file_id, state, created_at_ns`` at every change; state is kept by file."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, created = held.get if held.exists else ("", None)
        events = pd.concat(list(frames)).sort_values("at_ns", kind="stable")
        for event, at in zip(events["event"], events["at_ns"]):
            created = int(at) if created is None else created
            state = {"add": state or "waiting", "run": "processing", "remove": "removed"}.get(event, state)
        if state == "removed":
            held.remove()
        else:
            held.update((state, created))
        yield pd.DataFrame({"file_id": [key[0]], "state": [state], "created_at_ns": [created]})

    return log.groupBy("file_id").applyInPandasWithState(step, f"file_id string, {JOB_STATE}", JOB_STATE, "update", GroupStateTimeout.NoTimeout)


class Occupancy(StreamingQueryListener):
    """Samples ``(name, capacity, length)`` of every running query: rows waiting at its sources, against what a batch may take; a full buffer drops samples."""

    def __init__(self, capacity: int = 100, most: int = 1000):
        self.capacity, self.samples = capacity, deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.samples.append((p.name or str(p.id), self.capacity, int(p.numInputRows)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def ghosts(reports: DataFrame, at: str = "reported_at", seconds: int = GHOST_AFTER_S) -> DataFrame:
    """Stream of node reports -> ``node_id, last_at, status``: a node is a ghost when event time has gone on so long without it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            (last,) = held.get
            held.remove()
            yield pd.DataFrame({"node_id": [key[0]], "last_at": [pd.Timestamp(last, unit="us", tz="UTC").tz_localize(None)], "status": ["GHOST"]})
            return
        newest = max(f[at].max() for f in frames)
        last = int(newest.value // 1000)
        if held.exists:
            last = max(last, held.get[0])
        held.update((last,))
        held.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"node_id": [key[0]], "last_at": [pd.Timestamp(last, unit="us")], "status": ["ALIVE"]})

    stamped = reports.select("node_id", at).withWatermark(at, "0 seconds")
    return stamped.groupBy("node_id").applyInPandasWithState(step, "node_id string, last_at timestamp, status string", "last long", "update", GroupStateTimeout.EventTimeTimeout)


def supervise(start: Callable[[], StreamingQuery], restarts: int | None = None, delay_s: float = 0.2, on_restart: Callable[[int, Exception], None] | None = None) -> int:
    """Runs a query to its end and starts it again from its checkpoint after a failure, for ever or so many times; returns the number of restarts."""
    for n in itertools.count():
        try:
            start().awaitTermination()
            return n
        except Exception as error:
            if n == restarts:
                raise
            if on_restart:
                on_restart(n + 1, error)
            time.sleep(delay_s)
    raise AssertionError("unreachable")
