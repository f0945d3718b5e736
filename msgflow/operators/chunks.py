"""Files in chunks with a checksum, and back."""

from __future__ import annotations

import hashlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgflow.functions.mime import sniff
from msgflow.operators.validate import download_ok, file_error

DOWNLOAD_CHUNK = 128 << 10
SPECIALIST_CHUNK = 32 << 10


def split_chunks(files: DataFrame, key: str = "file_id", data: str = "content", size: int = DOWNLOAD_CHUNK) -> DataFrame:
    """``key, seq, kind, data, sha256``: metadata first, the chunks in order, the signature last; an empty file has no chunk."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    body = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct((i + 1).alias("seq"), F.lit("chunk").alias("kind"), F.substring(F.col(data), i * size + 1, F.lit(size)).alias("data"), F.lit(None).cast("string").alias("sha256")),
    )
    head = F.struct(F.lit(0).alias("seq"), F.lit("metadata").alias("kind"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("sha256"))
    tail = F.struct((n + 1).alias("seq"), F.lit("signature").alias("kind"), F.lit(None).cast("binary").alias("data"), F.sha2(F.col(data), 256).alias("sha256"))
    return files.filter(F.col(data).isNotNull()).select(key, F.inline(F.concat(F.array(head), body, F.array(tail))))


def reassemble(parts: DataFrame, key: str = "file_id", with_data: bool = True) -> DataFrame:
    """``key, data, n_bytes, n_chunks, sha256, expected, error``: the chunks of each file in order, hashed as they pass and checked against the signature.

    A chunk that was delivered twice counts once; ``MISSING_CHUNK`` if one is not there, ``CHECKSUM_MISMATCH`` if the signature isn't
    there or another, else the error that came instead of a signature.  A task holds one file, which the limit on files bounds; without ``with_data`` one chunk.
    """
    kind = parts.schema[key].dataType.simpleString()
    code = F.col("error_code") if "error_code" in parts.columns else F.lit(None).cast("string")
    slim = parts.select(F.col(key).alias("k"), "seq", "kind", "data", "sha256", code.alias("error_code")).filter(F.col("k").isNotNull() & (F.col("kind") != "metadata"))
    ordered = slim.repartition("k").sortWithinPartitions("k", "seq", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def done() -> pa.RecordBatch:
            error = state["error"] or ("MISSING_CHUNK" if state["missing"] else "CHECKSUM_MISMATCH" if state["expected"] != state["hash"].hexdigest() else None)
            data = b"".join(state["data"]) if with_data else None
            row = [state["k"], data, state["bytes"], state["n"], state["hash"].hexdigest(), state["expected"], error]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [state["type"], pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()])], names=[key, "data", "n_bytes", "n_chunks", "sha256", "expected", "error"])

        for b in batches:
            for k, seq, what, data, signature, failure in zip(*(b.column(c) for c in range(6))):
                if not state or state["k"] != k.as_py():
                    if state:
                        yield done()
                    state = {"k": k.as_py(), "type": b.schema.field(0).type, "hash": hashlib.sha256(), "data": [], "bytes": 0, "n": 0, "last": 0, "missing": False, "expected": None, "error": None}
                if what.as_py() == "chunk":
                    if seq.as_py() == state["last"] and state["n"]:
                        continue  # delivered twice
                    state["missing"] |= seq.as_py() != state["last"] + 1
                    piece = data.as_py() or b""
                    state["hash"].update(piece)
                    state["bytes"] += len(piece)
                    state["n"] += 1
                    state["last"] = seq.as_py()
                    if with_data:
                        state["data"].append(piece)
                elif what.as_py() == "signature":
                    state["missing"] |= seq.as_py() != state["last"] + 1
                    state["expected"] = signature.as_py()
                else:
                    state["error"] = failure.as_py() or "UNKNOWN"
        if state:
            yield done()

    return ordered.mapInArrow(run, f"`{key}` {kind}, data binary, n_bytes long, n_chunks int, sha256 string, expected string, error string")


def download(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Answers to download requests ``file_id, path``: the file's chunks, or a typed error.

    ``files`` has ``path, content, size, regular, exists, readable``.  A request without an id or a path is answered with
    ``INVALID_REQUEST``, one for an unknown path with ``NOT_FOUND``; a request sent twice is answered once.  Result: as ``split_chunks``, with ``error_code, size, mime_type``.
    """
    asked = requests.select("file_id", "path").distinct()
    found = asked.join(files.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"), "left")
    code = F.when(~download_ok(F.col("file_id"), F.col("path")), "INVALID_REQUEST").otherwise(
        file_error(F.col("size"), F.coalesce("regular", F.lit(False)), F.coalesce("exists", F.lit(False)), F.coalesce("readable", F.lit(False)))
    )
    checked = found.withColumn("error_code", code)
    mime = sniff(F.col("content"))
    none = F.lit(None)
    good = checked.filter(F.col("error_code").isNull()).withColumn("mime_type", mime)
    parts = split_chunks(good, "file_id").join(good.select("file_id", "size", "mime_type"), "file_id")
    head = F.col("kind") == "metadata"
    parts = parts.select("file_id", "seq", "kind", "data", "sha256", none.cast("string").alias("error_code"), F.when(head, F.col("size")).alias("size"), F.when(head, F.col("mime_type")).alias("mime_type"))
    bad = checked.filter(F.col("error_code").isNotNull())
    return parts.unionByName(bad.select("file_id", F.lit(1).alias("seq"), F.lit("error").alias("kind"), none.cast("binary").alias("data"), none.cast("string").alias("sha256"), "error_code", none.cast("long").alias("size"), none.cast("string").alias("mime_type")))


def decode_response(parts: DataFrame) -> DataFrame:
    """One of ``metadata``, ``chunk``, ``signature`` and ``error`` per row as columns; the rest is NULL."""
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    return parts.select("file_id", "seq", of("metadata", "mime_type").alias("mime_type"), of("metadata", "size").alias("size"), of("chunk", "data").alias("chunk"), of("signature", "sha256").alias("signature"), of("error", "error_code").alias("error_code"))
