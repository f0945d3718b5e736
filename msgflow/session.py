"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and
    the master is local (tests) a folder of this machine is taken.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is unset; it has to name a folder that all executors share")
    if not path:
        path = os.path.join(tempfile.gettempdir(), f"msgflow-{uuid.uuid4().hex}")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and read it from there.

    Unlike a cached or locally checkpointed frame it outlives any executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def require(df: DataFrame, *columns: str) -> None:
    """Raise ``ValueError`` if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the frame has {df.columns}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
