"""Monitoring: counters, rates, states of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GHOST_AFTER_S = 15
LATENCY_MS = 500
NODE_ORDER = ("MASTER", "SCANNER")


def ingest_summary(files: DataFrame, size: str) -> DataFrame:
    return files.agg(F.count("*").alias("files_received"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_processed"))


def event_counts(events: DataFrame, kind: str) -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("n_events"))


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of conditional counts."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def throughput(df: DataFrame, at: str, size: str, seconds: int = 1) -> DataFrame:
    """``window_start, bytes, mb_per_s`` per tumbling window."""
    w = df.groupBy(F.window(at, f"{seconds} seconds").alias("w")).agg(F.sum(size).alias("bytes"))
    return w.select(F.col("w.start").alias("window_start"), "bytes", (F.col("bytes") / (1024 * 1024) / seconds).alias("mb_per_s"))


def latest_nodes(reports: DataFrame, at: str = "reported_at") -> DataFrame:
    """Last report of every node; a tie goes to the higher report id."""
    cols = [c for c in reports.columns if c != "node_id"]
    return reports.groupBy("node_id").agg(F.max_by(F.struct(*cols), F.struct(at, "report_id")).alias("_r")).select("node_id", "_r.*")


def node_state(nodes: DataFrame, now: Column, at: str = "reported_at", seconds: int = GHOST_AFTER_S) -> DataFrame:
    """``status`` ALIVE, or GHOST after so many silent seconds; in the order of the node list."""
    silent = F.unix_micros(now) - F.unix_micros(F.col(at)) > seconds * 1_000_000
    kind = F.upper(F.coalesce(F.col("node_type"), F.lit("")))
    rank = F.when(kind == NODE_ORDER[0], 0).when(kind == NODE_ORDER[1], 1).otherwise(2)
    return nodes.withColumn("status", F.when(silent, "GHOST").otherwise("ALIVE")).withColumn("rank", rank)


def load_percent(queue: Column, capacity: Column) -> Column:
    return F.least(F.lit(100.0), queue / F.greatest(capacity, F.lit(1)) * 100)


def low_capacity(length: Column, capacity: Column, threshold: int) -> Column:
    free = capacity - length
    return (capacity > 0) & (free > 0) & (free <= threshold)


def late(start: Column, end: Column, threshold_ms: int = LATENCY_MS) -> Column:
    return F.unix_micros(end) - F.unix_micros(start) > threshold_ms * 1000


def recent(df: DataFrame, at: str, key: str, n: int = 20) -> DataFrame:
    """The n newest rows with their rank; the rank is given after the cut."""
    top = df.orderBy(F.desc(at), F.desc(key)).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(at), F.desc(key))))


def merge_stats(stats: DataFrame, at: str = "at") -> DataFrame:
    """Last known value of every statistic."""
    return stats.agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in stats.columns if c != at))


def accuracy(df: DataFrame, category: str, passed: Column) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n_cases"), F.avg(passed.cast("double")).alias("accuracy"))
