"""Row operators of a stream: projection, filters, first occurrences, limits, merges."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The total order of events.
ORDER = ("ts", "event_id")


def where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows for which the condition is true; null drops the row."""
    return df.where(cond)


having = where


def select(df: DataFrame, *fields: str, **exprs: Column) -> DataFrame:
    return df.select(*fields, *[e.alias(n) for n, e in exprs.items()])


def emit(df: DataFrame, *, as_type: str | None = None, **exprs: Column) -> DataFrame:
    """Output boundary: a projection, with the output's event type if one is named."""
    named = [F.lit(as_type).alias("event_type")] if as_type else []
    return df.select(*named, *[e.alias(n) for n, e in exprs.items()])


def distinct_first(df: DataFrame, *keys: str, order: Sequence[str] = ORDER) -> DataFrame:
    """The first row of each key; without keys, of each content (all columns but the order)."""
    by = list(keys) or [c for c in df.columns if c not in order]
    # A partial aggregate keeps one row for each key and task, so hot keys shrink before the shuffle.
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]).agg(first.alias("_r")).select("_r.*")


def limit_first(df: DataFrame, n: int, *, order: Sequence[str] = ORDER) -> DataFrame:
    """The first n events of the stream."""
    return df.orderBy(*order).limit(n)


def order_by(df: DataFrame, *cols: str | Column, n: int | None = None) -> DataFrame:
    out = df.orderBy(*cols)
    return out if n is None else out.limit(n)


def merge(*branches: tuple[DataFrame, Column | None]) -> DataFrame:
    """Events of all branches. Branches over one frame are a disjunction: an event passes once."""
    frames: list[tuple[DataFrame, list[Column | None]]] = []
    for df, cond in branches:
        for known, conds in frames:
            if known is df:
                conds.append(cond)
                break
        else:
            frames.append((df, [cond]))
    parts = [df if any(c is None for c in conds) else df.where(functools.reduce(Column.__or__, conds)) for df, conds in frames]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def timer(spark, start: str, end: str, every: str, *, name: str = "Timer") -> DataFrame:  # noqa: ANN001
    """Ticks between two timestamps; the first tick is one interval after the start."""
    ticks = F.explode(F.sequence(F.to_timestamp_ntz(F.lit(start)) + F.expr(f"INTERVAL {every}"), F.to_timestamp_ntz(F.lit(end)), F.expr(f"INTERVAL {every}")))
    out = spark.range(1).select(F.lit(name).alias("event_type"), ticks.alias("ts"))
    return out.withColumn("timestamp", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long"))


def enrich(df: DataFrame, reference: DataFrame, *, key: Column, ref_key: str, fields: Sequence[str], fallback: Mapping[str, object] | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """Looks fields up by key. Without a fallback unmatched events are dropped; with one they get it and status 'error'.

    The reference is broadcast if its columns are estimated at no more than `most_bytes` (from the sizes of its files,
    no row is read for that), else joined by shuffle. Looked-up fields take the place of equally named ones of the
    events; an event whose key is null has no match.
    """
    ref = reference.select(F.col(f"`{ref_key}`").alias("_enrich_key"), F.struct(*[F.col(f"`{f}`") for f in fields]).alias("_enrich_row")).dropDuplicates(["_enrich_key"])
    small = int(str(ref._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), key.alias("_key"))
    out = rows.join(F.broadcast(ref) if small else ref, F.col("_key") == F.col("_enrich_key"), "left" if fallback is not None else "inner")
    hit = F.col("_enrich_row").isNotNull()
    found = {f: F.col("_enrich_row").getField(f) for f in fields}
    if fallback is not None:
        found = {f: F.when(hit, v).otherwise(F.lit(fallback.get(f))) for f, v in found.items()}
    kept = [c for c in df.columns if c not in found and c != "enrich_status"]
    return out.select(*[F.col("_row").getField(c).alias(c) for c in kept], *[v.alias(f) for f, v in found.items()], F.when(hit, "ok").otherwise("error").alias("enrich_status"))
