"""Stream joins: the latest event of each source, intervals, absence."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import micros

DEFAULT_WINDOW = 60_000_000


def latest_join(sources: Mapping[str, tuple[DataFrame, str]], *, window_micros: int = DEFAULT_WINDOW, split: int | None = None) -> DataFrame:
    """On each arrival, the most recent event of every source with the same key within the window, as structs.

    `sources` gives (frame, key column) by name. No join: sources are united and each keeps its last event along
    the key, so the work grows with the events. split: a key's events are dealt out by slices of `split` windows, for
    keys that hold a large share of them; the events of a slice's last window go to the next slice as well, which is
    all it can look back to, so the rows are the same.
    """
    names = list(sources)
    parts = []
    for name, (df, key) in sources.items():
        own = F.struct(*df.columns)
        parts.append(df.select(F.col(key).cast("string").alias("_key"), F.col("ts").alias("_ts"), F.col("event_id").alias("_id"), *[(own if n == name else F.lit(None)).alias(n) for n in names], F.lit(names.index(name)).alias("_src")))
    union = functools.reduce(lambda a, b: a.unionByName(b), parts)
    keys, own = ["_key"], F.lit(True)
    if split:
        width, us = window_micros * split, micros("_ts")
        slice_ = F.floor(us / width)
        union = union.withColumn("_slice", F.explode(F.when((slice_ + 1) * width - us <= window_micros, F.array(slice_, slice_ + 1)).otherwise(F.array(slice_))))
        keys, own = ["_key", "_slice"], F.col("_slice") == slice_
    spec = Window.partitionBy(*keys).orderBy("_ts", "_id", "_src").rowsBetween(Window.unboundedPreceding, 0)
    out = union.withColumns({n: F.last(n, ignorenulls=True).over(spec) for n in names})
    fresh = [F.col(n).isNotNull() & (micros(F.col(f"{n}.ts")) >= micros("_ts") - window_micros) for n in names]
    return out.where(functools.reduce(Column.__and__, fresh, own)).select(F.col("_key").alias("key"), F.col("_ts").alias("ts"), *names)


def bucketed(df: DataFrame, width: int, ahead: bool, ts: str = "ts") -> DataFrame:
    """Time buckets of the width, so that an interval join has an equality key: its left side looks one bucket ahead."""
    b = F.floor(micros(ts) / width)
    return df.withColumn("_bucket", F.explode(F.array(b, b + 1)) if ahead else b)


def interval_join(left: DataFrame, right: DataFrame, *, key: str, within_micros: int, extra: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs of structs (l, r) of equal key with l before r, by at most `within`."""
    a = bucketed(left.select(F.struct(*left.columns).alias("l"), F.col(key).alias("_k"), F.col("ts").alias("_t")), within_micros, True, "_t")
    b = bucketed(right.select(F.struct(*right.columns).alias("r"), F.col(key).alias("_k2"), F.col("ts").alias("_t2")), within_micros, False, "_t2").withColumnRenamed("_bucket", "_bucket2")
    later = F.struct("r.ts", "r.event_id") > F.struct("l.ts", "l.event_id")
    on = (F.col("_k") == F.col("_k2")) & (F.col("_bucket") == F.col("_bucket2")) & later & (micros("_t2") <= micros("_t") + within_micros)
    return a.join(b, on if extra is None else on & extra, how).select("l", "r")


def absence(left: DataFrame, right: DataFrame, *, key: str, within_micros: int, extra: Column | None = None) -> DataFrame:
    """Events of the left that no event of the right of equal key follows within the time."""
    hits = interval_join(left, right, key=key, within_micros=within_micros, extra=extra).select(F.col("l.event_id").alias("_id")).distinct()
    return left.join(hits, F.col("event_id") == F.col("_id"), "left_anti")
