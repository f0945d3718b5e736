"""Sources: file trees, dictionaries, tables, message and file streams."""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from msgflow.errors import EmptyWords
from msgflow.functions.mime import is_authorized, sniff
from msgflow.operators.validate import MAX_FILE_BYTES, MAX_MAGIC, source_type


HEAD = "path string, size long, modified_at timestamp, magic_bytes binary, error string"


def _open(path: str):
    """A stream over a file of any file system that pyarrow knows; Spark writes local paths with one slash."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_stream(inner)


def heads(files: DataFrame, n: int = MAX_MAGIC) -> DataFrame:
    """``path, size, modified_at`` with the first bytes of every file; only those are read.  A file that can't be opened has an error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            magic, errors = [], []
            for path in b.column(0).to_pylist():
                try:
                    with _open(path) as stream:
                        magic.append(stream.read(n))
                    errors.append(None)
                except (OSError, pa.ArrowInvalid) as error:
                    magic.append(None)
                    errors.append(type(error).__name__)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(magic, pa.binary()), pa.array(errors, pa.string())], names=["path", "size", "modified_at", "magic_bytes", "error"])

    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")).mapInArrow(run, HEAD)


def scan(spark: SparkSession, path: str, authorized_only: bool = True) -> DataFrame:
    """Files of a tree: ``path, size, modified_at, magic_bytes, error, mime_type``; of the contents the first 64 bytes are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = heads(listed).withColumn("mime_type", sniff(F.col("magic_bytes")))
    return out.filter(is_authorized(F.col("mime_type"))) if authorized_only else out


def scan_counters(scanned: DataFrame) -> DataFrame:
    """``files, directories, bytes, skipped, errors`` of a whole scan; skipped are types that aren't authorised."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    failed = F.col("error").isNotNull()
    return scanned.agg(
        F.count("*").alias("files"), F.count_distinct(folder).alias("directories"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(~failed & ~is_authorized(F.col("mime_type"))).alias("skipped"), F.count_if(failed).alias("errors"),
    )


def requests(scanned: DataFrame, drive_id: str, source: str = "LOCAL_FIXED") -> DataFrame:
    """Analysis requests of scanned files."""
    return scanned.filter(F.col("error").isNull()).select(
        "path", F.lit(drive_id).alias("drive_id"), "size", F.lit(0).alias("attributes"), "mime_type", "magic_bytes", F.current_timestamp().alias("scanned_at"), source_type(F.lit(source)).alias("source_type")
    )


def read_bodies(spark: SparkSession, path: str, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """``file_id, content`` of the files within the size limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") <= limit).select(F.col("path").alias("file_id"), "content")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word, lang`` of a folder of word lists; the language is the name of the file; raises ``EmptyWords``."""
    lines = spark.read.text(path).select(F.trim("value").alias("word"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("lang"))
    words = lines.filter(F.col("word") != "").groupBy("word").agg(F.min("lang").alias("lang"))  # a word of several lists counts once
    if words.isEmpty():
        raise EmptyWords(path)
    return words


def key_range(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Keys alone: other columns aren't read."""
    return df.filter(condition).select(key)


def stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int = 100, bytes_per_trigger: int | None = None) -> DataFrame:
    """A folder of records as a stream; a batch takes so many files, or so many bytes where that is given."""
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    return spark.readStream.schema(schema).format(fmt).option(*limit).load(path)
