"""Keyset pages, top-k and queues; filters reach the scan, the order needs no full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgflow.operators.store import latest_fixed, latest_matching
from msgflow.session import require


def cursor_of(at: Column, key: Column) -> Column:
    """Cursor of a row: padded time and key."""
    return F.concat(F.lpad(at.cast("string"), 19, "0"), F.lit(":"), key)


def split_cursor(cursor: str) -> tuple[int, str]:
    at, _, key = cursor.partition(":")
    return int(at), key


def before(cursor: str, at: str, key: str) -> Column:
    """Rows strictly after a cursor in newest-first order."""
    when, last = split_cursor(cursor)
    return (F.col(at) < when) | ((F.col(at) == when) & (F.col(key) < last))


def newest_page(df: DataFrame, at: str, key: str, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """Newest first, ties by key descending, from the cursor on; all rows without a limit."""
    require(df, at, key)
    page = df.filter(before(cursor, at, key)) if cursor else df
    page = page.orderBy(F.desc(at), F.desc(key))
    return page if limit is None else page.limit(limit)


def room_messages(log: DataFrame, room: int, cursor: str | None = None) -> DataFrame:
    """Messages of a room up to a cursor, redelivered ones once.  Room and time of a message never change, so both reach the scan."""
    wanted = F.col("room") == room
    if cursor:
        wanted = wanted & (F.col("at_ns") <= split_cursor(cursor)[0])
    return latest_fixed(log, "id", "write_seq", wanted)


def namespace_analyses(log: DataFrame, namespace: str) -> DataFrame:
    """Records whose last version is in the namespace."""
    return latest_matching(log, "entity_id", "write_seq", F.col("namespace") == namespace)


def history(messages: DataFrame, room: int, limit: int | None = 5, cursor: str | None = None) -> DataFrame:
    """Message history of a room: ``id, sender_id, content, created_at_ns, cursor``."""
    page = newest_page(messages.filter(F.col("room") == room), "at_ns", "id", limit, cursor)
    return page.select("id", F.col("author").alias("sender_id"), "content", F.col("at_ns").alias("created_at_ns"), cursor_of(F.col("at_ns"), F.col("id")).alias("cursor"))


def next_cursor(rows: list, limit: int) -> str | None:
    """Cursor after a page that was read with one row more than ``limit``; None on the last page."""
    return f"{rows[limit - 1]['at_ns']:019d}:{rows[limit - 1]['entity_id']}" if len(rows) > limit else None


def next_batch(tasks: DataFrame, n: int) -> DataFrame:
    """The n pending tasks that are next: by priority, then first in, first out."""
    return tasks.filter(F.col("state") == "pending").orderBy("priority", "created_at_ns", "id").limit(n)


def mark_processing(tasks: DataFrame, chosen: DataFrame) -> DataFrame:
    """``tasks`` with the chosen ones, if still pending, moved to processing."""
    hit = chosen.select(F.col("id").alias("_chosen")).distinct()
    moved = tasks.join(hit, F.col("id") == F.col("_chosen"), "left")
    return moved.withColumn("state", F.when(F.col("_chosen").isNotNull() & (F.col("state") == "pending"), "processing").otherwise(F.col("state"))).drop("_chosen")


def admit(jobs: DataFrame, running: DataFrame, most: int) -> DataFrame:
    """Waiting jobs that may start: not running yet, once per file, oldest first, at most ``most`` in all."""
    free = max(0, most - running.count())
    waiting = jobs.join(running.select("file_id").distinct(), "file_id", "left_anti")
    once = waiting.groupBy("file_id").agg(F.min("created_at_ns").alias("created_at_ns"))
    return once.orderBy("created_at_ns", "file_id").limit(free)
