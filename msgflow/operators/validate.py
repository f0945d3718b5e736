"""Validation as columns: rejected rows keep their reasons, the stream goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CONTENT_BYTES = 1000
MAX_PATH, MAX_MIME, MAX_MAGIC = 1024, 128, 64
MAX_FILE_BYTES = 100 << 20
SOURCE_TYPES = ("UNSPECIFIED", "LOCAL_FIXED", "REMOVABLE", "NETWORK")


def content_fits(content: Column, limit: int = MAX_CONTENT_BYTES) -> Column:
    """Length in bytes; NULL is no message."""
    return F.coalesce(F.octet_length(content) <= limit, F.lit(False))


def request_reasons() -> Column:
    """Names of the fields of a file request that are wrong."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {
        "path": blank("path") | (F.length("path") > MAX_PATH),
        "drive_id": blank("drive_id"),
        "mime_type": blank("mime_type") | (F.length("mime_type") > MAX_MIME),
        "magic_bytes": F.coalesce(F.octet_length("magic_bytes"), F.lit(0)) > MAX_MAGIC,
        "scanned_at": F.col("scanned_at").isNull(),
        "source_type": ~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def check_requests(df: DataFrame) -> DataFrame:
    """``df`` with ``reasons``; valid rows have none."""
    return df.withColumn("reasons", request_reasons())


def source_type(value: Column) -> Column:
    """One of ``SOURCE_TYPES``, by name or number; anything else is unspecified."""
    by_number = F.try_element_at(F.array(*map(F.lit, SOURCE_TYPES)), value.try_cast("int") + 1)
    name = F.upper(F.trim(value.cast("string")))
    return F.when(name.isin(*SOURCE_TYPES), name).otherwise(F.coalesce(F.when(value.try_cast("int") >= 0, by_number), F.lit(SOURCE_TYPES[0])))


def priority(value: Column) -> Column:
    """0 (high) or 1 (normal); an unknown priority is normal."""
    return F.when(F.upper(F.trim(value.cast("string"))).isin("0", "HIGH"), 0).otherwise(1)


def download_ok(file_id: Column, path: Column) -> Column:
    """A download request names a file and a path."""
    return (F.trim(F.coalesce(file_id.cast("string"), F.lit(""))) != "") & (F.trim(F.coalesce(path, F.lit(""))) != "") & (F.length(path) <= MAX_PATH)


def file_error(size: Column, regular: Column, exists: Column, readable: Column, limit: int = MAX_FILE_BYTES) -> Column:
    """Error code of a download, NULL if it may go ahead."""
    return (
        F.when(~exists, "NOT_FOUND").when(~readable, "ACCESS_DENIED").when(~regular, "NOT_FILE").when(size > limit, "FILE_TOO_LARGE")
    )


def registration_ok(email: Column, password: Column) -> Column:
    """E-mail form, 12 to 72 characters, a small and a capital letter, a digit and something else."""
    good = email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & F.length(password).between(12, 72)
    return F.coalesce(good & password.rlike(r"\p{Lu}") & password.rlike(r"\p{Ll}") & password.rlike(r"\p{Nd}") & password.rlike(r"[\p{P}\p{S}]"), F.lit(False))


def throttle_ms(queue: Column, capacity: Column, soft: int = 70, hard: int = 90) -> Column:
    """Pause of a producer by the fill of its queue."""
    limit = lambda pct: F.floor(capacity * pct / 100)
    return F.when(queue > limit(hard), 200).when(queue > limit(soft), 20).otherwise(0)
