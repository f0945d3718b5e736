"""Delivery to subscribers, projections for the wire, telemetry and jobs."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgflow.errors import Overloaded
from msgflow.session import require


def chat_events(messages: DataFrame) -> DataFrame:
    """``message_id, room, sender_id, content, at_ns``: what a subscriber of a room receives."""
    return messages.select(F.col("id").alias("message_id"), "room", F.col("author").alias("sender_id"), "content", "at_ns")


def chat_line(at: Column, author: Column, content: Column) -> Column:
    """``[time] author: content``; a missing author or content is empty."""
    return F.concat(F.lit("["), F.date_format(at, "HH:mm:ss"), F.lit("] "), F.coalesce(author, F.lit("")), F.lit(": "), F.coalesce(content, F.lit("")))


def deliver(events: DataFrame, capacity: int, sink: str = "sink", tick: str = "tick", order: tuple[str, ...] = ("at_ns", "id"), parts: int = 32) -> DataFrame:
    """``events`` with ``delivered``: in every tick a sink's buffer takes its first ``capacity`` events; the others are dropped for it.

    The first of each part of a sink's events are found first, then the first of these, so the events of a busy sink aren't sorted in one task.
    """
    require(events, sink, tick, *order)
    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    row = F.struct(*order)
    firsts = events.select(sink, tick, part.alias("_part"), row.alias("_row")).withColumn("_k", F.row_number().over(Window.partitionBy(sink, tick, "_part").orderBy("_row"))).filter(F.col("_k") <= capacity)
    last = firsts.withColumn("_k", F.row_number().over(Window.partitionBy(sink, tick).orderBy("_row"))).filter(F.col("_k") == capacity).select(F.col(sink).alias("_sink"), F.col(tick).alias("_tick"), F.col("_row").alias("_last"))
    joined = events.join(last, (F.col(sink) == F.col("_sink")) & (F.col(tick) == F.col("_tick")), "left")
    return joined.withColumn("delivered", F.col("_last").isNull() | (row <= F.col("_last"))).drop("_sink", "_tick", "_last")


class RoomSink:
    """A bounded buffer for one subscriber; an event that finds no place within the timeout is dropped and counted."""

    def __init__(self, capacity: int = 100, timeout_s: float = 0.01):
        self.buffer: queue.Queue = queue.Queue(capacity)
        self.timeout_s, self.dropped = timeout_s, 0

    def consume(self, event) -> bool:
        try:
            self.buffer.put(event, timeout=self.timeout_s)
            return True
        except queue.Full:
            self.dropped += 1
            return False

    def __call__(self, batch: DataFrame, number: int) -> None:
        """As a streaming sink: rows of the batch one by one."""
        for row in batch.toLocalIterator():
            self.consume(row)

    def read(self) -> list:
        out = []
        while not self.buffer.empty():
            out.append(self.buffer.get_nowait())
        return out


class Admission:
    """Commands wait for a place so long, then fail with ``Overloaded``."""

    def __init__(self, capacity: int, timeout_s: float = 0.1):
        self.queue: queue.Queue = queue.Queue(capacity)
        self.timeout_s, self.rejected = timeout_s, 0

    def post(self, command) -> None:
        try:
            self.queue.put(command, timeout=self.timeout_s)
        except queue.Full:
            self.rejected += 1
            raise Overloaded("the queue is full") from None

    def take(self):
        return self.queue.get_nowait()


class InFlight:
    """At most so many sends at a time; counts sends and bytes.  ``with in_flight(size): send()``."""

    def __init__(self, most: int = 100):
        self._places, self._lock = threading.BoundedSemaphore(most), threading.Lock()
        self.sent, self.bytes = 0, 0

    @contextmanager
    def __call__(self, size: int):
        with self._places:
            yield
        with self._lock:
            self.sent += 1
            self.bytes += size


# --- wire -------------------------------------------------------------------------------


def to_wire(analyses: DataFrame) -> DataFrame:
    """Stored records as they are sent: no NULL, score names in lower case (of several alike the greatest value)."""
    low = F.transform_keys(F.map_from_entries(F.array_distinct(F.transform(F.map_entries("scores"), lambda e: F.struct(F.lower(e["key"]), F.array_max(F.transform(F.filter(F.map_entries("scores"), lambda o: F.lower(o["key"]) == F.lower(e["key"])), lambda o: o["value"])))))), lambda k, _: k)
    text = lambda c: F.coalesce(c, F.lit(""))
    return analyses.withColumn("scores", F.coalesce(low, F.create_map().cast("map<string,double>"))).withColumn("summary", text(F.col("summary"))).withColumn("namespace", text(F.col("namespace"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def from_wire(records: DataFrame) -> DataFrame:
    """The other way: empty texts are missing ones."""
    return records.withColumn("summary", F.nullif("summary", F.lit(""))).withColumn("namespace", F.nullif("namespace", F.lit("")))


def stats_json(stats: DataFrame) -> DataFrame:
    """One JSON text per row of statistics."""
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("json"))


def reporter_line(ram: Column, disk: Column, net: Column, files: Column, waiting: Column) -> Column:
    return F.format_string("ram %s | disk %s | net %s | files %d | queue %d", ram, disk, net, files, waiting)


# --- telemetry --------------------------------------------------------------------------

Handler = Callable[[DataFrame], DataFrame]


def health_events(reports: DataFrame) -> DataFrame:
    """Node reports as events ``type, name, at, payload``: one for the process, one for the queue."""
    process = F.struct(F.lit("process").alias("type"), F.to_json(F.struct("pid", "pid_status", "cpu_percent", "ram_bytes")).alias("payload"))
    fill = F.struct(F.lit("capacity").alias("type"), F.to_json(F.struct(F.col("max_capacity").alias("capacity"), F.col("queue_size").alias("length"))).alias("payload"))
    return reports.select(F.col("node_id").alias("name"), F.col("reported_at").alias("at"), F.explode(F.array(process, fill)).alias("e")).select("e.type", "name", "at", "e.payload")


def handle(events: DataFrame, handlers: dict[str, Handler], kind: str = "type") -> dict[str, DataFrame]:
    """Every handler gets the events of its type."""
    return {name: h(events.filter(F.col(kind) == name)) for name, h in handlers.items()}


# --- jobs -------------------------------------------------------------------------------


def find_jobs(responses: DataFrame, jobs: DataFrame) -> DataFrame:
    """``responses`` with the drive and path of their job; one without a job is left out."""
    return responses.join(jobs.select("file_id", "drive_id", "path").dropDuplicates(["file_id"]), "file_id")


def track(log: DataFrame, at: str = "at_ns") -> DataFrame:
    """Last state of every job from a log of ``file_id, event`` (add, run, remove); removed ones are gone."""
    state = log.groupBy("file_id").agg(F.max_by("event", at).alias("event"), F.min(at).alias("created_at_ns"))
    return state.filter(F.col("event") != "remove").select("file_id", "created_at_ns", F.when(F.col("event") == "run", "processing").otherwise("waiting").alias("state"))


def tracker_state(jobs: DataFrame, most: int) -> DataFrame:
    """``processing, max``."""
    return jobs.agg(F.count_if(F.col("state") == "processing").alias("processing")).withColumn("max", F.lit(most))
