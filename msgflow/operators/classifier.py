"""Toxicity of a message from hashed words: one feature function for training and use."""

import string
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgflow.functions.text import FNV_OFFSET, FNV_PRIME, fnv1a

TOXIC = 0.35
PER_CLASS = 5000
PRIORITY_TIMES = 2000  # times that a row which must be learned is repeated


@lru_cache(maxsize=1 << 18)
def _fnv(word: str) -> int:
    """As ``msgflow.functions.text.fnv1a``; words recur, so each worker works one out once."""
    h = FNV_OFFSET
    for byte in word.encode():
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFF
    return h


def word_features(text: str | None, size: int) -> list[int]:
    return sorted({_fnv(w) % size for w in (text or "").lower().split()})


def _dense(text: Column, size: int) -> Column:
    @F.pandas_udf("array<double>")
    def spread(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), size))
        for row, t in zip(out, texts):
            row[word_features(t, size)] = 1.0
        return pd.Series(list(out))

    return array_to_vector(spread(text))


def training_rows(cases: DataFrame, label: str, per_class: int = PER_CLASS, seed: int = 42) -> DataFrame:
    """At most ``per_class`` rows of each class, by a seeded hash, so the sample is the same each time."""


    known = cases.filter(F.col("text").isNotNull() & F.col(label).isNotNull())
    rank = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 40))
    parts = []
    for value, n in sorted((r[0], r[1]) for r in known.groupBy(label).count().collect()):
        mine = known.filter(F.col(label) == value)
        # a share by hash first, wider than needed, so that the rows sorted are about as many as are taken
        few = mine.filter(rank < int((1 << 40) * min(1.0, 2.0 * per_class / n)))
        parts.append((few if few.count() >= min(n, per_class) else mine).orderBy(rank, "text").limit(per_class))
    out = parts[0] if parts else known
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_priority(rows: DataFrame, urgent: DataFrame, times: int = PRIORITY_TIMES) -> DataFrame:
    """Training rows and, each ``times`` over, the rows that must be learned (of the same columns), in a seeded order."""
    repeated = urgent.select(*rows.columns).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_n")
    return rows.unionByName(repeated).orderBy(F.rand(42))


def count_features(text: Column, size: int = 1024) -> Column:
    """``array<struct<id, n>>``: how often each hashed word occurs, after ASCII punctuation was taken out."""
    bare = F.translate(F.lower(text), string.punctuation, "")
    ids = F.transform(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), lambda w: fnv1a(w) % size)
    return F.transform(F.array_sort(F.array_distinct(ids)), lambda i: F.struct(i.alias("id"), F.size(F.filter(ids, lambda x: x == i)).alias("n")))


def fit(cases: DataFrame, text: str = "text", label: str = "is_malicious", size: int = 1024) -> LogisticRegressionModel:
    rows = training_rows(cases.withColumnRenamed(text, "text"), label)
    data = rows.select(_dense(F.col("text"), size).alias("features"), F.col(label).cast("double").alias("label"))
    data = data.coalesce(4).persist()  # bounded by PER_CLASS; every iteration reads it again
    try:
        return LogisticRegression(maxIter=50, regParam=0.01).fit(data)
    finally:
        data.unpersist()


def check(df: DataFrame, model: LogisticRegressionModel, text: str) -> DataFrame:
    """``df`` with ``toxicity`` and ``is_toxic``; only the weights of a text's own words are summed."""
    weights, bias = np.array(model.coefficients.toArray()), float(model.intercept)

    size = model.numFeatures
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [word_features(t, size) for t in b.column(b.num_columns - 1).to_pylist()]
            n = np.array([len(f) for f in found], np.int64)
            flat = np.fromiter((i for f in found for i in f), np.int64, int(n.sum()))
            z = np.bincount(np.repeat(np.arange(len(n)), n), weights[flat], len(n)) + bias
            p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array(p > TOXIC)], names=[*b.schema.names[:-1], "toxicity", "is_toxic"])

    with_text = df.select(*df.columns, F.col(text).cast("string").alias("_text"))
    return with_text.mapInArrow(score, f"{kept}, toxicity double, is_toxic boolean")
