"""Queries over busy keys (problem 2) and implausible readings (problem 4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgflow.operators import skew, spikes
from msgflow.session import table

NUDGE = 1e-9  # keeps a mean that lies on a rounding boundary from depending on the order of summation
HEAVY_SHARE = 0.025  # fixed by the task: a key with at least this share of all rows is heavy


def _room_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per room: its messages, and what was analysed of them."""
    return skew.joined_stats(
        table(spark, sf_dir, "messages"),
        table(spark, sf_dir, "analyses"),
        left_key="room",
        left_on="id",
        left_value="toxicity_score",
        right_on="entity_id",
        right_value=F.cardinality("scores"),
    )


def _namespace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per namespace: its analyses, and the messages they are about."""
    return skew.joined_stats(
        table(spark, sf_dir, "analyses").withColumn("n_scores", F.cardinality("scores")),
        table(spark, sf_dir, "messages"),
        left_key="namespace",
        left_on="entity_id",
        left_value="n_scores",
        right_on="id",
        right_value=F.col("toxicity_score"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, states in (("messages", _room_join), ("analyses", _namespace_join)):
        total = table(spark, sf_dir, name).count()
        heavy = skew.heavy_keys(states(spark, sf_dir), total, HEAVY_SHARE, rows="n_left")
        parts.append(heavy.select(F.lit(name).alias("record_table"), "key_value"))
    return parts[0].unionByName(parts[1])


def p2_joined_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = _room_join(spark, sf_dir).withColumn("record_table", F.lit("messages"))
    spaces = _namespace_join(spark, sf_dir).withColumn("record_table", F.lit("analyses"))
    return rooms.unionByName(spaces).select(
        "record_table", "key_value", "n_left", "n_joined", "n_matched", F.round(F.col("mean_left") + NUDGE, 6).alias("mean_left"), F.round(F.col("mean_right") + NUDGE, 6).alias("mean_right")
    )


def p2_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = skew.key_stats(table(spark, sf_dir, "messages"), "room", "id", "at_ns", "toxicity_score").withColumn("record_table", F.lit("messages"))
    spaces = skew.key_stats(table(spark, sf_dir, "analyses"), "namespace", "entity_id", "at_ns").withColumn("record_table", F.lit("analyses"))
    return rooms.unionByName(spaces).select("record_table", "key_value", "n_rows", "n_entities", "latest_at", F.round(F.col("mean_value") + NUDGE, 6).alias("mean_value"))


def p2_namespace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_map_means(table(spark, sf_dir, "analyses"), "namespace", "scores").withColumn("mean_score", F.round(F.col("mean_score") + NUDGE, 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag_readings(table(spark, sf_dir, "node_status")).select("report_id", "metric").distinct()


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag_readings(table(spark, sf_dir, "node_status"))


def p4_bounds_and_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that SQL can check: impossible and stuck readings."""
    return p4_flags(spark, sf_dir).filter("kind <> 'spike'")


QUERIES = {f.__name__: f for f in (p2_found, p2_joined_stats, p2_key_stats, p2_namespace_scores, p4_found, p4_flags, p4_bounds_and_runs)}

SQL = {
    "p4_bounds_and_runs": """
        WITH once AS (SELECT DISTINCT ON (report_id) * FROM node_status ORDER BY report_id),
        r AS (SELECT report_id, node_id, reported_at, 'cpu_percent' AS metric, CAST(cpu_percent AS DOUBLE) AS v, isnan(cpu_percent) OR cpu_percent < 0 OR cpu_percent > 100 AS bad, NULL AS idle FROM once
              UNION ALL SELECT report_id, node_id, reported_at, 'ram_bytes', CAST(ram_bytes AS DOUBLE), ram_bytes <= 0 OR ram_bytes > 70368744177664, NULL FROM once
              UNION ALL SELECT report_id, node_id, reported_at, 'queue_size', CAST(queue_size AS DOUBLE), queue_size < 0 OR queue_size > 2147483648 OR coalesce(queue_size > max_capacity, false), 0 FROM once),
        g AS (SELECT *, row_number() OVER (PARTITION BY node_id, metric ORDER BY reported_at, report_id) - row_number() OVER (PARTITION BY node_id, metric, v ORDER BY reported_at, report_id) AS run FROM r WHERE v IS NOT NULL AND reported_at IS NOT NULL),
        n AS (SELECT *, count(*) OVER (PARTITION BY node_id, metric, v, run) AS length FROM g)
        SELECT report_id, metric, 'stuck' AS kind FROM n WHERE length >= 10 AND NOT bad AND NOT coalesce(v = idle, false)
        UNION ALL SELECT report_id, metric, 'impossible' FROM r WHERE v IS NOT NULL AND bad""",
    "p2_found": """
        SELECT 'messages' AS record_table, CAST(room AS VARCHAR) AS key_value FROM messages WHERE room IS NOT NULL
        GROUP BY room HAVING count(*) >= 0.025 * (SELECT count(*) FROM messages)
        UNION ALL
        SELECT 'analyses', namespace FROM analyses WHERE namespace IS NOT NULL
        GROUP BY namespace HAVING count(*) >= 0.025 * (SELECT count(*) FROM analyses)""",
    "p2_joined_stats": """
        SELECT 'messages' AS record_table, CAST(m.room AS VARCHAR) AS key_value,
               (SELECT count(*) FROM messages x WHERE x.room = m.room) AS n_left,
               count(a.entity_id) AS n_joined, count(DISTINCT CASE WHEN a.entity_id IS NOT NULL THEN m.id END) AS n_matched,
               round(avg(CASE WHEN a.entity_id IS NOT NULL AND NOT isnan(m.toxicity_score) THEN m.toxicity_score END) + 1e-9, 6) AS mean_left,
               round(avg(cardinality(a.scores)) + 1e-9, 6) AS mean_right
        FROM messages m LEFT JOIN analyses a ON a.entity_id = m.id WHERE m.room IS NOT NULL GROUP BY m.room
        UNION ALL
        SELECT 'analyses', a.namespace, (SELECT count(*) FROM analyses x WHERE x.namespace = a.namespace),
               count(m.id), count(DISTINCT CASE WHEN m.id IS NOT NULL THEN a.entity_id END),
               round(avg(CASE WHEN m.id IS NOT NULL THEN cardinality(a.scores) END) + 1e-9, 6),
               round(avg(CASE WHEN NOT isnan(m.toxicity_score) THEN m.toxicity_score END) + 1e-9, 6)
        FROM analyses a LEFT JOIN messages m ON a.entity_id = m.id WHERE a.namespace IS NOT NULL GROUP BY a.namespace""",
    "p2_key_stats": """
        SELECT 'messages' AS record_table, CAST(room AS VARCHAR) AS key_value, count(*) AS n_rows, count(DISTINCT id) AS n_entities,
               max(at_ns) AS latest_at, round(avg(CASE WHEN NOT isnan(toxicity_score) THEN toxicity_score END) + 1e-9, 6) AS mean_value
        FROM messages WHERE room IS NOT NULL GROUP BY room
        UNION ALL
        SELECT 'analyses', namespace, count(*), count(DISTINCT entity_id), max(at_ns), NULL
        FROM analyses WHERE namespace IS NOT NULL GROUP BY namespace""",
    "p2_namespace_scores": """
        SELECT namespace AS key_value, lower(e.key) AS score, count(e.value) AS n_scores, round(avg(e.value) + 1e-9, 6) AS mean_score
        FROM (SELECT namespace, unnest(map_entries(scores)) AS e FROM analyses WHERE namespace IS NOT NULL)
        WHERE e.value IS NOT NULL AND NOT isnan(e.value) GROUP BY namespace, lower(e.key)""",
}
