"""Windows as tags on rows (a window id or a start) or as frames that aggregates run over.

A window closes when a later event arrives: with flush=False the trailing partial window is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..checkpoints import cut
from .basic import ORDER
from .scan import scan


def _over(keys: Sequence[str], order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def partition_label(c: Column) -> Column:
    """The key of a partitioned aggregate as text."""
    return F.coalesce(c.cast("string"), F.lit("default")).alias("_partition")


def numbered(df: DataFrame, column: str, *, order: Sequence[str] = ORDER) -> DataFrame:
    """The rows with their place in the whole order, from 1, without bringing them into one task.

    Rows are sorted by ranges and kept in a checkpoint; the driver sums one count for each range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = cut(parts.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    sizes = sorted((r["_p"], r["count"]) for r in parts.groupBy("_p").count().collect())
    before, starts = 0, []
    for p, size in sizes:
        starts.append((p, before))
        before += size
    offsets = df.sparkSession.createDataFrame(starts, "_p int, _start long")
    return parts.join(F.broadcast(offsets), "_p").withColumn(column, F.col("_start") + F.col("_i") + 1).drop("_p", "_i", "_start")


def count_window(df: DataFrame, n: int, *, keys: Sequence[str] = (), flush: bool = False, order: Sequence[str] = ORDER) -> DataFrame:
    """Tags rows with w_id, the number of their window of n rows."""
    if not keys:
        out = numbered(df, "_rn", order=order).withColumn("w_id", F.floor((F.col("_rn") - 1) / n).cast("long")).drop("_rn")
        return out if flush else out.where(F.col("w_id") < df.count() // n)
    rn = F.row_number().over(_over(keys, order))
    out = df.withColumn("w_id", F.floor((rn - 1) / n).cast("long"))
    if not flush:
        out = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("w_id") < F.floor(F.col("_n") / n)).drop("_n")
    return out


def _framed(agg: Column | Callable[[WindowSpec], Column], frame: WindowSpec) -> Column:
    """A plain aggregate over the frame; expressions of several are given as functions of the frame."""
    return agg.over(frame) if isinstance(agg, Column) else agg(frame)


def sliding_count(df: DataFrame, n: int, slide: int, aggs: Mapping[str, Column | Callable[[WindowSpec], Column]], *, keys: Sequence[str] = (), order: Sequence[str] = ORDER) -> DataFrame:
    """At rows max(n, slide) + k * slide of a key: the aggregates over the last n rows."""
    spec = _over(keys, order)
    start = max(n, slide)
    out = df.withColumns({"_rn": F.row_number().over(spec)} | {a: _framed(c, spec.rowsBetween(-(n - 1), 0)) for a, c in aggs.items()})
    return out.where((F.col("_rn") >= start) & ((F.col("_rn") - start) % slide == 0)).drop("_rn")


def session_window(df: DataFrame, gap_micros: int, *, keys: Sequence[str] = (), flush: bool = False, order: Sequence[str] = ORDER) -> DataFrame:
    """Tags rows with w_id, the number of their session; a pause of more than the gap parts sessions."""
    spec = _over(keys, order)
    out = df.withColumn("_break", (micros("ts") - F.lag(micros("ts")).over(spec) > gap_micros).cast("int"))
    out = out.withColumn("w_id", F.coalesce(F.sum("_break").over(spec), F.lit(0)).cast("long")).drop("_break")
    if not flush:
        out = out.withColumn("_last", F.max("w_id").over(Window.partitionBy(*keys))).where("w_id < _last").drop("_last")
    return out


def tumbling_aligned(df: DataFrame, size: str) -> DataFrame:
    """Tags rows with w_start, the start of their epoch-aligned window."""
    return df.withColumn("w_start", F.window("ts", size)["start"])


def sliding_aligned(df: DataFrame, size: str, slide: str) -> DataFrame:
    """A row for each aligned window that covers it, with w_start."""
    return df.withColumn("_w", F.window("ts", size, slide)).withColumn("w_start", F.col("_w.start")).drop("_w")


def tumbling_anchored(df: DataFrame, size_micros: int, *, keys: Sequence[str] = (), flush: bool = False, order: Sequence[str] = ORDER) -> DataFrame:
    """Tags rows with w_start: windows start at a key's first event, then at the event that closes the last one."""
    at = df.columns.index("ts")

    def step(state: object, batch: pa.RecordBatch) -> tuple[object, pa.Array]:
        ts = batch.column(at).cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
        out, k = np.empty(len(ts), np.int64), 0
        start = ts[0] if state is None else state
        while k < len(ts):
            if ts[k] >= start + size_micros:
                start = ts[k]
            end = k + int(np.searchsorted(ts[k:], start + size_micros, side="left"))
            out[k:end] = start
            k = end
        return start, pa.array(out).cast(pa.timestamp("us"))

    out = scan(df, keys, step, "w_start", "timestamp_ntz", order=order)
    if not flush:
        out = out.withColumn("_last", F.max("w_start").over(Window.partitionBy(*keys))).where("w_start < _last").drop("_last")
    return out


def sliding_anchored(df: DataFrame, size_micros: int, slide_micros: int, aggs: Mapping[str, Column | Callable[[WindowSpec], Column]], *, keys: Sequence[str] = (), order: Sequence[str] = ORDER) -> DataFrame:
    """Aggregates over [t - size, t] at a key's first event and at each event `slide` or more after the last emission.

    Events of one timestamp are in each other's contents.
    """
    at = df.columns.index("ts")

    def step(state: object, batch: pa.RecordBatch) -> tuple[object, pa.Array]:
        ts = batch.column(at).cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
        out, k = np.zeros(len(ts), bool), 0
        if state is None:
            out[0], state, k = True, ts[0], 1
        while True:
            k += int(np.searchsorted(ts[k:], state + slide_micros, side="left"))
            if k >= len(ts):
                return state, pa.array(out)
            out[k], state, k = True, ts[k], k + 1

    out = scan(df, keys, step, "_emits", "boolean", order=order).withColumn("_us", micros("ts"))
    frame = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-size_micros, 0)
    return out.withColumns({a: _framed(c, frame) for a, c in aggs.items()}).where("_emits").drop("_emits", "_us")


def delayed(df: DataFrame, n: int, column: str, *, keys: Sequence[str] = (), order: Sequence[str] = ORDER) -> Column:
    """The column's value n arrivals ago."""
    return F.lag(column, n).over(_over(keys, order))
