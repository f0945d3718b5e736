"""Documents into containers of a fixed number of tokens, by bulk-synchronous best fit.

Sizes are whole numbers up to the capacity, so documents of one size are alike and so
are containers with one gap; both are held as runs (value, first rank or container,
count), of which there are a bounded number whatever the corpus.  In every round the
runs of documents and of gaps are sorted into ranges of values and the executors
sweep each range from its largest value down: a document takes the smallest gap that
holds it (its successor); the k-th document takes the k-th container of a run, which
settles conflicts by rank; gaps that stay in the range are met again in the same
sweep.  What a range could not match is swept once more across the ranges; gaps that
changed go to their new range, and the next round begins.  When a round places
nothing, the largest documents left open new containers.

The documents are ranked where they are read and placed by their rank; pieces that fill a container need no match.
"""

import base64
import heapq
from collections import Counter
from pathlib import Path
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgflow.session import empty, materialize, require

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # has to be there on every worker
# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RUNS = "kind string, value long, first long, n long, container long, each long"

Run = tuple[int, int, int]  # value, first rank or container, count
Match = tuple[int, int, int, int, int]  # size, first rank, count, first container, documents in each


def encoder(path: str = TOKENIZER):
    """``text -> token ids`` with a vocabulary file of ranks; there are no special tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


# --- sweeps ----------------------------------------------------------------------------


def sweep(docs: list[Run], gaps: list[Run], low: int) -> tuple[list[Match], list[Run], list[Run], list[Run]]:
    """Best fit over one range: matches, documents left, gaps no document took, and gaps that changed.

    Runs are met from the largest value down, gaps before documents, so the last gap met is the successor of
    the document at hand.  A gap that changed but is still larger than ``low`` is met again.
    """
    heap = [(-v, 0, f, n) for v, f, n in gaps] + [(-v, 1, f, n) for v, f, n in docs]
    heapq.heapify(heap)
    open_: list[Run] = []
    matches, left, changed = [], [], []

    def put(gap: int, container: int, n: int) -> None:
        if gap > low:
            heapq.heappush(heap, (-gap, 0, container, n))
        elif gap:
            changed.append((gap, container, n))

    while heap:
        value, is_doc, first, n = heapq.heappop(heap)
        value = -value
        if not is_doc:
            open_.append((value, first, n))
            continue
        while n and open_:
            gap, container, m = open_.pop()
            each = gap // value
            full = min(m, n // each)
            if full:
                matches.append((value, first, full * each, container, each))
                put(gap - each * value, container, full)
                first, n, container, m = first + full * each, n - full * each, container + full, m - full
            if m and n:  # fewer documents than the next container holds
                matches.append((value, first, n, container, n))
                put(gap - n * value, container, 1)
                n, container, m = 0, container + 1, m - 1
            if m:
                open_.append((gap, container, m))
        if n:
            left.append((value, first, n))
    return matches, left, open_, changed


def open_containers(docs: list[Run], used: int, capacity: int) -> tuple[list[Match], list[Run], list[Run], int]:
    """New containers for the largest documents (those over half the size of the largest), one after the other: matches, documents left, gaps, containers in use."""
    docs = sorted(docs, reverse=True)
    half = docs[0][0] // 2
    matches, gaps = [], []
    gap, begun = 0, False
    for size, first, n in docs:
        if size <= half:
            break
        if gap >= size:
            take = min(gap // size, n)
            matches.append((size, first, take, used, take))
            first, n, gap = first + take, n - take, gap - take * size
        if not n:
            continue
        if begun:
            gaps.append((gap, used, 1))
            used += 1
        each = capacity // size
        full = n // each
        if full:
            matches.append((size, first, full * each, used, each))
            gaps.append((capacity - each * size, used, full))
            first, n, used = first + full * each, n - full * each, used + full
        begun = n > 0
        gap = capacity - n * size if begun else 0
        if begun:
            matches.append((size, first, n, used, n))
    if begun:
        gaps.append((gap, used, 1))
        used += 1
    return matches, [d for d in docs if d[0] <= half], [g for g in gaps if g[0]], used


def _frame(**parts: list) -> pd.DataFrame:
    """Rows of ``RUNS``: matches have five fields, runs three."""
    rows = [(kind, *r, *(() if len(r) == 5 else (-1, -1))) for kind, runs in parts.items() for r in runs]
    return pd.DataFrame(rows, columns=["kind", "value", "first", "n", "container", "each"])


def _runs(pdf: pd.DataFrame, kind: str) -> list[tuple]:
    cols = ["value", "first", "n", "container", "each"] if kind == "match" else ["value", "first", "n"]
    return list(pdf.loc[pdf["kind"] == kind, cols].itertuples(index=False, name=None))


def _range(value: int) -> int:
    return (value - 1).bit_length()


def sweep_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sweep of one range: sizes and gaps over half a power of two, up to it."""
    top = _range(int(pdf["value"].iloc[0]))
    matches, left, kept, changed = sweep(_runs(pdf, "doc"), _runs(pdf, "gap"), (1 << top) >> 1)
    return _frame(match=matches, doc=left, gap=kept, changed=changed)


def sweep_borders(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the ranges left, across their borders: a document takes a gap of a higher range."""
    matches, left, kept, changed = sweep(_runs(pdf, "doc"), _runs(pdf, "gap"), int(pdf["value"].max()))
    return _frame(match=_runs(pdf, "match") + matches, doc=left, gap=kept + changed + _runs(pdf, "changed"))


def best_fit(spark: SparkSession, sizes: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows ``(size, first rank, count, first container, documents in each)`` and the number of containers.

    The driver starts the rounds and keeps the runs between them; their number is bounded by the capacity and the rounds, not by the documents.
    """
    docs: list[Run] = [(s, 0, n) for s, n in sizes.items() if s and n]
    gaps: list[Run] = []
    done: list[Match] = []
    used = 0
    while docs:
        placed: list = []
        if gaps:
            state = spark.createDataFrame(_frame(doc=docs, gap=gaps), RUNS).withColumn("range", F.ceil(F.log2(F.col("value").cast("double")) - 1e-9))
            swept = state.groupBy("range").applyInPandas(sweep_range, RUNS).groupBy().applyInPandas(sweep_borders, RUNS).toPandas()
            placed, docs, gaps = _runs(swept, "match"), _runs(swept, "doc"), _runs(swept, "gap")
        if not placed:
            placed, docs, new, used = open_containers(docs, used, capacity)
            gaps += new
        done += placed
    return np.array(done, np.int64).reshape(-1, 5), used


# --- documents -------------------------------------------------------------------------


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """``_key, n_tokens, part, full_before, rank``: of every row, the task that read it, the full pieces before it in the task, and its rank there among rests of its size; NULL counts as empty text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part, full, seen = TaskContext.get().partitionId(), 0, Counter()
        for b in batches:
            tokens, before, rank = [], [], []
            for t in b.column(1).to_pylist():
                n = len(encode(t)) if t else 0
                tokens.append(n)
                before.append(full)
                rank.append(seen[n % capacity])
                full += n // capacity
                seen[n % capacity] += 1
            cols = [pa.array(x, pa.int64()) for x in (tokens, np.full(len(tokens), part), before, rank)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["_key", "n_tokens", "part", "full_before", "rank"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"_key {kind}, n_tokens long, part long, full_before long, rank long")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """A container for every document: ``key, piece, n_tokens, container_id``.

    A document of at most ``capacity`` tokens has the one piece 0.  A longer one is cut
    into pieces of exactly ``capacity`` tokens, each filling a container, and a rest that
    is packed like any other document.  Empty and NULL texts have one piece of no tokens and the
    container NULL; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    require(df, key, text)
    spark = df.sparkSession
    counts = materialize(token_counts(df, key, text, tokenizer, capacity))
    rest = F.col("n_tokens") % capacity
    per_task = counts.groupBy("part", rest.alias("size")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n_tokens") / capacity)).alias("full"))
    per_task = materialize(per_task)
    sizes = {r["size"]: r["n"] for r in per_task.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    if not sizes:
        return empty(spark, df.select(key).schema).select(key, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("container_id"))
    plan, used = best_fit(spark, {s: n for s, n in sizes.items() if s}, capacity)
    # full pieces, after the containers of the rests
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.groupBy("part").agg(F.sum("full").alias("n")).select("part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + used).alias("start"))  # one row a task
    whole = (
        counts.filter(F.col("n_tokens") >= capacity).join(F.broadcast(starts), "part")
        .select("_key", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_tokens") / capacity).cast("int") - 1)).alias("piece"), (F.col("start") + F.col("full_before")).alias("at"))
        .select("_key", "piece", F.lit(capacity).cast("long").alias("n_tokens"), (F.col("at") + F.col("piece")).alias("container_id"))
    )
    # rests, by their rank among all rests of the size
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rests = counts.filter((rest > 0) | (F.col("n_tokens") == 0)).select("_key", F.floor(F.col("n_tokens") / capacity).cast("int").alias("piece"), rest.alias("size"), "part", "rank").join(offsets, ["part", "size"])
    share = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    kind = df.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = share.value
        span = int(table[:, 1].max()) + 1 if len(table) else 1
        starts = table[:, 0] * span + table[:, 1]
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            container = np.zeros(len(size), np.int64)
            if len(table):
                row = table[np.maximum(np.searchsorted(starts, size * span + np.minimum(rank, span - 1), side="right") - 1, 0)]
                container = row[:, 3] + (rank - row[:, 1]) // row[:, 4]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container, mask=size == 0)], names=["_key", "piece", "n_tokens", "container_id"])

    placed = rests.select("_key", "piece", "size", (F.col("rank") + F.col("offset")).alias("rank")).mapInArrow(place, f"_key {kind}, piece int, n_tokens long, container_id long")
    return placed.unionByName(whole).withColumnRenamed("_key", key)
