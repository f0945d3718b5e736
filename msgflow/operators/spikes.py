"""Implausible readings in per-source measurement series.

A source's series of a metric is cut into chunks of a fixed number of readings with a
halo on either side, so a source that sends a third of all reports is spread over many
tasks.  Inside a chunk the undecimated Haar wavelet transform is taken forwards
and backwards: detail coefficients for every reading and scale, whose sum with the
approximation is the series.  They are scaled by the robust deviation (MAD) of the
source's own finest coefficients around the reading.

* spike: at the onset the forward details, at the end the backward details are beyond
  the threshold at the finest scale and over all scales, at most ``MAX_WIDTH`` readings
  apart, and the approximations on both sides agree; the excursion is then taken out and the
  transform repeated, until nothing more is found;
* stuck: a run of zero details of the finest scale, at least ``MIN_RUN`` readings long;
* impossible: outside the physical bounds of the metric.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgflow.session import require

CHUNK = 2048  # readings of a series in one chunk
HALO = 64  # readings repeated on either side
MAX_WIDTH = 3  # longest spike, in readings
MIN_RUN = 10  # shortest stuck run, in readings
LEVELS = 2  # scales of the transform: the approximation is the mean of 2 ** LEVELS readings
NOISE = 32  # readings before and after from which the noise around a reading is taken
STRIDE = 16  # readings that share one estimate of the noise
THRESHOLD = 7.0  # robust deviations of a reading beyond which its detail coefficients make a spike
RETURN = 0.35  # share of its height by which the level may differ after a spike
TURNS = 4  # times that found excursions are taken out at most
FLAG_SCHEMA = "report_id long, metric string, kind string"


@dataclass(frozen=True)
class Metric:
    """A measured column: bounds, an optional column that bounds it, and values that may repeat.

    ``floor`` is the least noise as a share of the level, ``unit`` the resolution of a reading.
    """

    name: str
    low: float
    high: float
    low_open: bool = False
    cap: str | None = None
    idle: float | None = None
    floor: float = 0.005
    unit: float = 0.0


NODE_METRICS = (
    Metric("cpu_percent", 0.0, 100.0, unit=0.01),
    Metric("ram_bytes", 0.0, float(1 << 46), low_open=True),  # 64 TiB: more than any machine has
    Metric("queue_size", 0.0, float(1 << 31), cap="max_capacity", idle=0.0, floor=0.01, unit=1.0),
)


def impossible(x: np.ndarray, m: Metric, cap: np.ndarray | None) -> np.ndarray:
    """Readings outside the bounds; NaN is impossible as well (a missing reading must be masked by the caller)."""
    with np.errstate(invalid="ignore"):
        bad = ~(x <= m.high) | ((x <= m.low) if m.low_open else (x < m.low))
        if cap is not None:
            bad |= x > np.where(np.isnan(cap), np.inf, cap)
    return bad


def _outside(m: Metric) -> Column:
    """As ``impossible``, as a column; a missing reading is not outside."""
    v = F.col(m.name).cast("double")
    bad = F.isnan(v) | (v > m.high) | ((v <= m.low) if m.low_open else (v < m.low))
    if m.cap:
        cap = F.col(m.cap).cast("double")
        bad = bad | F.coalesce(~F.isnan(cap) & (v > cap), F.lit(False))
    return v.isNotNull() & bad


def stuck(x: np.ndarray, m: Metric, least: int = MIN_RUN) -> np.ndarray:
    """Reports in a run of zero details (finest Haar scale) of at least ``least`` reports."""
    out = np.zeros(len(x), bool)
    if len(x) < least:
        return out
    zero = np.concatenate(([False], np.diff(x) == 0, [False]))
    edge = np.flatnonzero(np.diff(zero.astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a + 1 >= least and not (m.idle is not None and x[a] == m.idle):
            out[a : b + 1] = True
    return out


def haar(x: np.ndarray, levels: int = LEVELS) -> tuple[list[np.ndarray], np.ndarray]:
    """Undecimated Haar transform: details of scales 1, 2, 4, ... at every reading, and the approximation; they add up to ``x``.

    The detail of scale ``s`` at ``i`` is half the difference between the mean of the ``s`` readings up to ``i`` and that of the ``s`` before them.
    """
    rest, details = np.asarray(x, float), []
    for level in range(levels):
        step = min(1 << level, len(rest))
        smooth = (rest + np.concatenate((np.repeat(rest[:1], step), rest[: len(rest) - step]))) / 2
        details.append(rest - smooth)
        rest = smooth
    return details, rest


def _deviation(d: np.ndarray, half: int) -> np.ndarray:
    """Robust deviation (MAD) of the coefficients around each one."""
    n = len(d)
    width = min(2 * half + 1, n)
    mad = np.median(np.lib.stride_tricks.sliding_window_view(np.abs(d), width)[::STRIDE], axis=1) / 0.6745
    return mad[np.clip((np.arange(n) - width // 2 + STRIDE // 2) // STRIDE, 0, len(mad) - 1)]


def spikes(x: np.ndarray, m: Metric, threshold: float = THRESHOLD, width: int = MAX_WIDTH, half: int = NOISE) -> np.ndarray:
    """Readings in excursions of one to ``width`` readings that the wavelet details single out.

    With two scales the forward details at ``i`` add up to three quarters of the
    difference between the reading and the three before it; the backward ones see the three after it.  A
    lasting change of level has large details on one side only, and its approximations differ.
    """
    n = len(x)
    out = np.zeros(n, bool)
    if n < 8:
        return out
    work, whole = x, 1.0 - 0.5**LEVELS
    for _ in range(TURNS):
        fine, before = haar(work)
        back, after = haar(work[::-1])
        back, after = [d[::-1] for d in back], after[::-1]
        level = np.maximum(np.abs(before), np.abs(after))
        # a finest detail is half a difference of two readings, so its deviation is that of a reading over the root of two
        noise = np.maximum.reduce([_deviation(fine[0], half), np.full(n, m.unit / np.sqrt(2)), m.floor * level / np.sqrt(2)])
        least = threshold * noise * np.sqrt(2)
        onset, end = sum(fine) / whole, sum(back) / whole
        new = np.zeros(n, bool)
        for w in range(1, width + 1):
            i = np.arange(1, n - w)
            k = i + w - 1
            apart = np.abs(after[k + 1] - before[i - 1])
            for sign in (1, -1):
                seen = [2 * fine[0][i], 2 * back[0][k], onset[i], end[k]]
                inside = onset[i]
                for step in range(1, w - 1):  # the readings between follow from the onset by the finest details
                    inside = inside + 2 * fine[0][i + step]
                    seen.append(inside)
                height = np.minimum.reduce([sign * c for c in seen])
                for at in np.flatnonzero((height > least[i]) & (apart < RETURN * height)):
                    new[i[at] : k[at] + 1] = True
        if not (new & ~out).any():
            break
        out |= new
        kept = np.flatnonzero(~out)
        if len(kept) < 8:
            break
        work = np.interp(np.arange(n), kept, x[kept])
    return out


def flag_series(x: np.ndarray, m: Metric, cap: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Masks ``impossible``, ``spike``, ``stuck`` over one ordered series without missing readings."""
    bad = impossible(x, m, cap)
    ok = np.flatnonzero(~bad)
    masks = {"impossible": bad, "spike": np.zeros(len(x), bool), "stuck": stuck(x, m) & ~bad}
    clean = x[ok]
    held = masks["stuck"][ok]
    masks["spike"][ok] = spikes(clean, m) & ~held
    return masks


def ordered_chunks(df: DataFrame, source: str, order: list[str], bucket_seconds: int, at: str, values: list[str], extra: dict[str, str], chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """One row per chunk and reading: ``source, _name, _chunk, _pos, _core, _value`` and the columns of ``order``.

    A reading is a value that is not NULL; it is core of one chunk, and again halo of
    a neighbour.  Its position in its source's series is the number of readings of the metric before it in a time bucket
    plus those of the source's earlier buckets, so no task sees the whole series of a source.
    ``extra`` names a further column of a metric, which comes out as ``_cap``.
    """
    keyed = df.withColumn("_bucket", F.floor(F.unix_timestamp(at) / bucket_seconds))
    earlier = Window.partitionBy(source).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(source, "_bucket").agg(*(F.count(v).alias(f"_n_{v}") for v in values))
        .select(F.col(source).alias("_src"), F.col("_bucket").alias("_b"), *(F.coalesce(F.sum(f"_n_{v}").over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values))
    )
    inside = Window.partitionBy(source, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = keyed.select("*", *(F.count(v).over(inside).alias(f"_rn_{v}") for v in values))
    joined = ranked.join(offsets, F.col(source).eqNullSafe(F.col("_src")) & (F.col("_bucket") == F.col("_b")))
    readings = F.array(
        *(
            F.struct(
                F.lit(v).alias("name"), F.col(v).cast("double").alias("value"), F.col(v).isNotNull().alias("there"),
                (F.col(extra[v]).cast("double") if v in extra else F.lit(None).cast("double")).alias("cap"), (F.col(f"_before_{v}") + F.col(f"_rn_{v}") - 1).alias("pos"),
            )
            for v in values
        )
    )
    flat = joined.select(source, *order, F.explode(readings).alias("r")).filter("r.there").select(source, *order, F.col("r.name").alias("_name"), F.col("r.value").alias("_value"), F.col("r.cap").alias("_cap"), F.col("r.pos").alias("_pos"))
    home, within = F.floor(F.col("_pos") / chunk), F.col("_pos") % chunk
    chunks = F.array_compact(F.array(home, F.when((within < halo) & (home > 0), home - 1), F.when(within >= chunk - halo, home + 1)))
    return flat.withColumn("_home", home).withColumn("_chunk", F.explode(chunks)).withColumn("_core", F.col("_chunk") == F.col("_home")).drop("_home")


def _flag_group(metrics: tuple[Metric, ...]):
    named = {m.name: m for m in metrics}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        m = named[pdf["_name"].iloc[0]]
        ids, core = pdf["_id"].to_numpy(), pdf["_core"].to_numpy()
        masks = flag_series(pdf["_value"].to_numpy(float), m, pdf["_cap"].to_numpy(float) if m.cap else None)
        found = [pd.DataFrame({"report_id": ids[mask & core], "metric": m.name, "kind": kind}) for kind, mask in masks.items()]
        return pd.concat(found, ignore_index=True)

    return run


def flag_readings(
    df: DataFrame,
    metrics: tuple[Metric, ...] = NODE_METRICS,
    *,
    source: str = "node_id",
    report: str = "report_id",
    at: str = "reported_at",
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """One row per implausible reading: ``report_id, metric, kind``.

    Reports sent twice (same ``report_id``) count once.  NULL readings are no
    readings: they are skipped, are never flagged and don't end a stuck run, however many they are.
    Reports without a time have no place in the series; only their bounds are checked.  Empty input
    gives no rows.  A reading that is impossible is neither spike nor stuck, and
    is left out of the series in which those are sought.
    """
    require(df, source, report, at, *(m.name for m in metrics), *(m.cap for m in metrics if m.cap))
    caps = {m.name: m.cap for m in metrics if m.cap}
    names = [m.name for m in metrics]
    once = (
        df.filter(F.col(report).isNotNull())
        .groupBy(F.col(report).alias("_id"))
        .agg(F.min(F.struct(F.col(at).alias("t"), F.col(source).alias("s"), *(F.col(c).alias(c) for c in dict.fromkeys([*names, *caps.values()])))).alias("r"))
        .select("_id", F.col("r.t").alias("_at"), F.col("r.s").alias("_source"), *(F.col(f"r.{c}") for c in dict.fromkeys([*names, *caps.values()])))
    )
    cut = ordered_chunks(once.filter(F.col("_at").isNotNull()), "_source", ["_at", "_id"], bucket_seconds, "_at", names, caps)
    flagged = cut.select("_source", "_chunk", "_name", "_id", "_pos", "_core", "_value", "_cap").groupBy("_source", "_name", "_chunk").applyInPandas(_flag_group(metrics), FLAG_SCHEMA)
    timeless = once.filter(F.col("_at").isNull()).select(F.col("_id").cast("long").alias("report_id"), F.explode(F.array_compact(F.array(*(F.when(_outside(m), F.lit(m.name)) for m in metrics)))).alias("metric"))
    return flagged.unionByName(timeless.withColumn("kind", F.lit("impossible")))
