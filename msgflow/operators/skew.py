"""Per-key results where a few keys hold most records.

Eager aggregation through joins: both inputs are first reduced to one compact
state per (key, join key), the states are joined, counts are multiplied and sums
combined algebraically, and only then rolled up to the key.  No task ever holds
the raw rows of a key: every aggregation has a map-side half, the join runs on
the high-cardinality join key, and what reaches the roll-up is at most one row
per key and map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgflow.session import require


def heavy_keys(states: DataFrame, total: Column | int, share: float, key: str = "key_value", rows: str = "n_rows") -> DataFrame:
    """Keys whose ``rows`` are at least ``share`` of ``total`` rows."""
    return states.filter(F.col(rows) >= F.lit(share) * total).select(key, rows)


MIN_HEAVY = 100_000  # a key with fewer rows is never heavy
MOST_HEAVY = 10_000  # a heavy key has more than this part of all rows, so there are at most so many


def heavy_groups(df: DataFrame, on: list[str], least: int = MIN_HEAVY) -> DataFrame:
    """The keys ``on`` that one task should not get whole: at most ``MOST_HEAVY`` rows, whatever the input.

    Rows are counted per task before the shuffle; NULL keys are never heavy, since they join with nothing.
    """
    counts = df.groupBy(*on).agg(F.count("*").alias("_n")).dropna(subset=on)
    total = df.count()
    return counts.filter(F.col("_n") > max(least, total // MOST_HEAVY)).select(*on)


def split_join(left: DataFrame, right: DataFrame, on: list[str], least: int = MIN_HEAVY) -> DataFrame:
    """``left JOIN right USING (on)`` where a few keys hold most rows of ``left``.

    ``right`` has a bounded number of rows a key.  Its rows of the heavy keys of
    ``left`` (at most ``MOST_HEAVY`` keys) go to every task, so the rows of such a key
    stay where they are; all other keys are shuffled.  NULL keys join with nothing.
    """
    require(left, *on)
    require(right, *on)
    heavy = heavy_groups(left, on, least)
    keys = heavy.limit(MOST_HEAVY + 1).collect()
    if not keys:
        return left.join(right, on)
    held = F.broadcast(left.sparkSession.createDataFrame(keys, heavy.schema).withColumn("_heavy", F.lit(True)))
    few = left.join(held, on, "left").filter(F.col("_heavy").isNull()).drop("_heavy").join(right, on)
    many = left.join(F.broadcast(right.join(held.drop("_heavy"), on, "left_semi")), on)
    return few.unionByName(many)


def _finite(c: Column) -> Column:
    """NaN counts as missing, as NULL does."""
    return F.when(~F.isnan(c), c)


def entity_states(df: DataFrame, key: str, entity: str, at: str, value: str | None = None) -> DataFrame:
    """First half: one state per (key, entity).

    Columns ``k, e, n, latest, s, c``: rows, latest time, sum and count of ``value``.
    Rows whose key is NULL have no key and are left out; a NULL entity keeps its
    rows but is not an entity.
    """
    require(df, key, entity, at, *([value] if value else []))
    v = _finite(F.col(value).cast("double")) if value else F.lit(None).cast("double")
    return (
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).cast("string").alias("k"), F.col(entity).alias("e"), F.col(at).alias("t"), v.alias("v"))
        .groupBy("k", "e")
        .agg(F.count("*").alias("n"), F.max("t").alias("latest"), F.sum("v").alias("s"), F.count("v").alias("c"))
    )


def key_stats(df: DataFrame, key: str, entity: str, at: str, value: str | None = None) -> DataFrame:
    """Rows, distinct entities, latest time and mean value of every key.

    Result: ``key_value string, n_rows, n_entities, latest_at, mean_value``.
    Empty input gives no rows; NULL keys have no row; a key without any value has
    a NULL mean; repeated rows count in ``n_rows`` and once in ``n_entities``.
    """
    return (
        entity_states(df, key, entity, at, value)
        .groupBy("k")
        .agg(
            F.sum("n").alias("n_rows"),
            F.count("e").alias("n_entities"),
            F.max("latest").alias("latest_at"),
            (F.sum("s") / F.sum("c")).alias("mean_value"),
        )
        .withColumnRenamed("k", "key_value")
    )


def key_map_means(df: DataFrame, key: str, scores: str) -> DataFrame:
    """Mean of every entry of a map column per key; names are compared in lower case.

    Result: ``key_value, score, n_scores, mean_score``; NULL and NaN entries don't count.
    """
    require(df, key, scores)
    return (
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).cast("string").alias("key_value"), F.explode(F.col(scores)).alias("name", "v"))
        .groupBy("key_value", F.lower("name").alias("score"))
        .agg(F.count(_finite(F.col("v"))).alias("n_scores"), F.avg(_finite(F.col("v"))).alias("mean_score"))
        .filter(F.col("n_scores") > 0)
    )


def joined_stats(
    left: DataFrame,
    right: DataFrame,
    *,
    left_key: str,
    left_on: str,
    left_value: str,
    right_on: str,
    right_value: Column,
) -> DataFrame:
    """Statistics over ``left JOIN right ON left_on = right_on`` per ``left_key``, without the joined rows.

    A left state with ``n`` rows and a right state with ``m`` rows stand for
    ``n * m`` joined rows; their sums are ``m * s_left`` and ``n * s_right``.  Keys
    of the left with no partner stay with zero joined rows; the rows of a key are
    those with a partner and those without, so they too come out of the join.

    Result: ``key_value, n_left, n_joined, n_matched, mean_left, mean_right``: rows of the key, joined
    rows, join keys with a partner, and the means of both values over the joined rows.
    """
    require(left, left_key, left_on, left_value)
    require(right, right_on)
    a = (
        left.filter(F.col(left_key).isNotNull())
        .select(F.col(left_key).cast("string").alias("k"), F.col(left_on).alias("j"), _finite(F.col(left_value).cast("double")).alias("v"))
        .groupBy("k", "j")
        .agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.count("v").alias("c"))
    )
    b = (
        right.filter(F.col(right_on).isNotNull())
        .select(F.col(right_on).alias("j2"), _finite(right_value.cast("double")).alias("w"))
        .groupBy("j2")
        .agg(F.count("*").alias("m"), F.sum("w").alias("s2"), F.count("w").alias("c2"))
    )
    return (
        a.join(b, a["j"] == b["j2"], "left")
        .groupBy("k")
        .agg(
            (F.sum(F.when(F.col("j2").isNull(), F.col("n")).otherwise(0)) + F.sum(F.when(F.col("j2").isNotNull(), F.col("n")).otherwise(0))).alias("n_left"),
            F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("n_joined"),
            F.count("j2").alias("n_matched"),
            (F.sum(F.col("s") * F.col("m")) / F.sum(F.col("c") * F.col("m"))).alias("mean_left"),
            (F.sum(F.col("s2") * F.col("n")) / F.sum(F.col("c2") * F.col("n"))).alias("mean_right"),
        )
        .withColumnRenamed("k", "key_value")
    )
