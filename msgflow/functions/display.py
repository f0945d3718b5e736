"""Projections for people: status names, rows of the inspector, tracker lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted spellings of a process status.
PID_STATUS = {
    "RUNNING": ("R", "RUNNING"),
    "SLEEP": ("S", "SLEEP", "SLEEPING"),
    "STOP": ("T", "STOP", "STOPPED"),
    "IDLE": ("I", "IDLE"),
    "ZOMBIE": ("Z", "ZOMBIE"),
    "WAIT": ("W",),
    "LOCK": ("L",),
}


def pid_status(status: Column) -> Column:
    """One of seven names; any other spelling is ``UNKNOWN``."""
    out = F.lit("UNKNOWN")
    for name, spellings in PID_STATUS.items():
        out = F.when(status.isin(*spellings), name).otherwise(out)
    return out


def searchable_text(summary: Column, payload_type: Column, payload: Column) -> Column:
    """Summary, then what the payload says, with single spaces."""
    s = F.coalesce(summary, F.lit(""))
    text = F.coalesce(payload["text"]["content"], F.lit(""))
    audio = F.coalesce(payload["audio"]["transcription"], F.lit(""))
    name = F.coalesce(payload["file"]["filename"], F.lit(""))
    body = F.coalesce(payload["file"]["content"], F.lit(""))
    return (
        F.when(payload_type == "audio", F.concat(s, F.lit(" "), audio))
        .when(payload_type == "file", F.concat(s, F.lit(" "), name, F.when(body != "", F.concat(F.lit(" "), body)).otherwise("")))
        .otherwise(F.concat(s, F.lit(" "), text))
    )


def inspect_rows(analyses: DataFrame) -> DataFrame:
    """Rows of the inspector: key parts, time of day, short id, label, detail and scores."""
    p = F.col("payload")
    body = F.coalesce(p["file"]["content"], F.lit(""))
    detail = (
        F.when(F.col("payload_type") == "audio", p["audio"]["transcription"])
        .when(F.col("payload_type") == "file", F.when(body != "", body).otherwise(F.col("summary")))
        .otherwise(p["text"]["content"])
    )
    parts = F.split(F.coalesce(F.col("namespace"), F.lit("")), ":")
    # scores have few decimals: one that lies half way is shown rounded down, as its binary value mostly is
    shown = F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.format_string("%s:%.2f", e["key"], e["value"] - 1e-9)))
    return analyses.select(
        "id",
        "write_seq",
        parts[0].alias("kind"),
        F.date_format("at_ts", "HH:mm:ss").alias("time"),
        F.left("entity_id", F.lit(8)).alias("short_id"),
        F.when(F.col("payload_type") == "text", "CHAT").when(F.col("payload_type") == "file", "FILE").when(F.col("payload_type") == "audio", "AUDIO").otherwise("BASE").alias("label"),
        F.coalesce(detail, F.lit("")).alias("detail"),
        F.coalesce(F.array_join(shown, " "), F.lit("")).alias("scores"),
    )


def tracker_line(metric: Column, pid: Column, status: Column, cpu: Column, ram: Column) -> Column:
    return F.format_string("%s %d %s %.2f%% %d", F.upper(metric), pid, status, cpu, ram)
