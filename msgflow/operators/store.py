"""Latest-wins tables over append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgflow.errors import NamespaceMismatch, NotFound
from msgflow.session import require


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last written row of every key.

    One aggregation with a map-side half instead of a window: a key with many
    versions never gathers them in one task.
    """
    require(df, key, seq)
    cols = [c for c in df.columns if c != key]
    packed = F.max_by(F.struct(*cols), F.col(seq)).alias("_row")
    return df.groupBy(key).agg(packed).select(*(F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in df.columns))


def latest_fixed(df: DataFrame, key: str, seq: str, condition: Column) -> DataFrame:
    """The last row of every key, of those that meet a condition on columns that all versions of a key share: it is pushed to the scan."""
    return latest(df.filter(condition), key, seq)


def latest_matching(df: DataFrame, key: str, seq: str, condition: Column) -> DataFrame:
    """The last row of every key, where it meets the condition.

    Whole rows are read and shuffled only where the condition holds; of the others no more than key and
    number are read, to see whether a later version has taken the row's place.
    """
    require(df, key, seq)
    found = latest(df.filter(condition), key, seq)
    newest = df.select(F.col(key).alias("_k"), F.col(seq).alias("_s")).groupBy("_k").agg(F.max("_s").alias("_s"))
    return found.join(newest, (F.col(key) == F.col("_k")) & (F.col(seq) == F.col("_s"))).drop("_k", "_s")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    return latest(stored.unionByName(incoming, allowMissingColumns=True), key, seq)


def fetch_by_entity(analyses: DataFrame, entity_id: str, namespace: str | None = None) -> DataFrame:
    """The record of an entity; raises ``NotFound`` or ``NamespaceMismatch``."""
    found = latest(analyses.filter(F.col("entity_id") == entity_id), "entity_id", "write_seq")
    rows = found.select("namespace").take(1)
    if not rows:
        raise NotFound(entity_id)
    if namespace is not None and rows[0]["namespace"] != namespace:
        raise NamespaceMismatch(entity_id)
    return found


def insert_unique(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet, the first of each key."""
    fresh = incoming.join(stored.select(key).distinct(), key, "left_anti")
    cols = [c for c in fresh.columns if c != key]
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_row"))
    return first.select(key, *(F.col(f"_row.`{c}`").alias(c) for c in cols))


def scan_prefix(df: DataFrame, key: str, prefix: str, skip: str = "idx:") -> DataFrame:
    return df.filter(F.col(key).startswith(prefix) & ~F.col(key).startswith(skip))
