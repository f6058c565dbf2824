"""Sequence patterns over keyed events, as window functions where a step only looks at its own event.

A run starts at every event of the first step. Each step takes the first later event that fits (greedy), and
the time limit holds for the last step, inclusively. Steps whose condition is local to the event are found by
windows over (key, order), read from the last step to the first, so a chain of any length costs one shuffle
and work in proportion to the events. Steps that compare with earlier aliases go through an interval join on
key and time bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .basic import ORDER
from .joins import bucketed, interval_join
from .windows import micros

#: A condition on an event's own columns.
Local = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Step:
    """A step of a pattern: alias, condition; `kleene` takes one or more events, `optional` none or one."""

    alias: str
    where: Local
    kleene: bool = False
    optional: bool = False


def of_type(name: str, more: Local | None = None, column: str = "event_type") -> Local:
    return (lambda c: c(column) == name) if more is None else (lambda c: (c(column) == name) & more(c))


def either(*conds: Local) -> Local:
    def cond(c: Callable[[str], Column]) -> Column:
        out = conds[0](c)
        for x in conds[1:]:
            out = out | x(c)
        return out

    return cond


def _own(name: str) -> Column:
    return F.col(name)


def _later(value: Column, key: Sequence[str], order: Sequence[str]) -> Column:
    """The first non-null value at a later row of the key: a running frame over the reversed order."""
    spec = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return F.last(value, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, -1))


def _earlier(value: Column, key: Sequence[str], order: Sequence[str]) -> Column:
    spec = Window.partitionBy(*key).orderBy(*order)
    return F.last(value, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, -1))


def sequence(events: DataFrame, steps: Sequence[Step], *, key: str, within_micros: int | None = None, unless: Local | None = None, strict: bool = False, split: int | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """Matches of the steps for each key: a struct column for each alias (of a Kleene step: its last event, and
    `<alias>_count`). With `unless`, an event that meets it after the start, up to and including the last,
    ends the run. strict: each step takes the very next event of the key or none.

    An optional step is null if the next step's event comes first.

    split: for keys that hold a large share of the events. A key's events are dealt out by slices of time, `split`
    time limits long; the events of a slice's first time limit go to the slice before as well, so every run
    finds all it can reach in the slice of its start, and the matches are the same.
    """
    if split and within_micros is None:
        raise ValueError("slices need a time limit")
    fields = events.columns
    row = F.struct(*[F.col(c) for c in fields])
    kleene = {s.alias for s in steps[1:] if s.kleene}
    df, keys = events, [key]
    if split:
        width = within_micros * split
        own_slice = F.floor(micros("ts") / width)
        shared = micros("ts") - own_slice * width < within_micros
        df = events.withColumn("_slice", F.explode(F.when(shared, F.array(own_slice - 1, own_slice)).otherwise(F.array(own_slice))))
        keys = [key, "_slice"]
    # What lies before an event, for Kleene steps: the last event that fits and how many have so far.
    for s in steps[1:]:
        if s.kleene:
            spec = Window.partitionBy(*keys).orderBy(*order)
            df = df.withColumns({
                f"_n_{s.alias}": F.sum(F.when(s.where(_own), 1).otherwise(0)).over(spec.rowsBetween(Window.unboundedPreceding, 0)),
                f"_p_{s.alias}": _earlier(F.when(s.where(_own), row), keys, order),
            })
    carried = [c for s in steps[1:] if s.kleene for c in (f"_n_{s.alias}", f"_p_{s.alias}")]
    rest: Column | None = None  # the struct of the steps after the present one, at every row
    for k in range(len(steps) - 1, 0, -1):
        s = steps[k]
        name = f"_s{k}"
        inner = [row.alias("e"), *[F.col(c) for c in carried]] + ([rest.alias("rest")] if rest is not None else [])
        fits = s.where(_own)
        here = F.when(fits if rest is None else fits & rest.isNotNull(), F.struct(*inner)) if strict else F.when(fits, F.struct(*inner))
        found = F.lead(here).over(Window.partitionBy(*keys).orderBy(*order)) if strict else _later(here, keys, order)
        df = df.withColumn(name, found)
        if s.optional and rest is not None:
            # The step counts only if it comes before the next one; the chain behind it starts at the same next event.
            nxt = rest
            before = F.struct(*[F.col(name)["e"][c] for c in order]) < F.struct(*[nxt["e"][c] for c in order])
            df = df.withColumn(name, F.when(nxt.isNotNull(), F.struct(F.when(F.col(name).isNotNull() & before, F.col(name)["e"]).alias("e"), *[F.col(name)[c].alias(c) for c in carried], nxt.alias("rest"))))
        rest = F.col(name)
    if unless is not None:
        df = df.withColumn("_bad", _later(F.when(unless(_own), F.struct(*[F.col(c) for c in order])), keys, order))
    df = df.where(steps[0].where(_own) & ((F.col("_slice") == own_slice) if split else F.lit(True)))
    out, path, last = {steps[0].alias: row}, rest, row
    held: list[tuple[Step, Column]] = []
    for k, s in enumerate(steps[1:], 2):
        held.append((s, path))
        path = path["rest"] if k < len(steps) else path
    cond = F.lit(True)
    for k, (s, p) in enumerate(held):
        e, after = p["e"], held[k + 1][1] if k + 1 < len(held) else None
        if s.alias in kleene and after is not None:
            # First event of the step, then the closing event; what was absorbed lies between.
            n = after[f"_n_{s.alias}"] - F.when(s.where(lambda c, a=after: a["e"][c]), 1).otherwise(0) - p[f"_n_{s.alias}"] + 1
            out[s.alias] = F.when(e.isNotNull(), F.coalesce(after[f"_p_{s.alias}"], e))
            out[f"{s.alias}_count"] = F.when(e.isNotNull(), n).otherwise(0).cast("long")
        else:
            out[s.alias] = e
        if not s.optional:
            cond = cond & p.isNotNull() & e.isNotNull()
        last = e
    if within_micros is not None:
        cond = cond & (micros(last["ts"]) <= micros("ts") + within_micros)
    if unless is not None:
        cond = cond & (F.col("_bad").isNull() | (F.col("_bad") > F.struct(*[last[c].alias(c) for c in order])))
    return df.where(cond).select(*[v.alias(n) for n, v in out.items()])


def sequence_by_condition(starts: DataFrame, candidates: DataFrame, cond: Column, *, key: str, within_micros: int) -> DataFrame:
    """For each start (struct l) the first later candidate (struct r) of the key that meets a condition on both."""
    pairs = interval_join(starts, candidates, key=key, within_micros=within_micros, extra=cond)
    first = F.min_by("r", F.struct("r.ts", "r.event_id"))
    return pairs.groupBy(F.col("l.event_id").alias("_id")).agg(F.first("l").alias("l"), first.alias("r")).drop("_id")


def every_match(events: DataFrame, steps: Sequence[Step], *, key: str, within_micros: int) -> DataFrame:
    """All combinations of events that meet the steps in order within the time, not only the greedy ones.

    The result grows with the product of what fits into a time limit; each step is an interval join on key and bucket.
    """
    first = steps[0].alias
    row = F.struct(*[F.col(c) for c in events.columns])
    out = events.where(steps[0].where(_own)).select(row.alias(first), F.struct("ts", "event_id").alias("_prev"))
    for s in steps[1:]:
        left = bucketed(out.withColumn("_t", F.col(f"{first}.ts")), within_micros, True, "_t")
        right = bucketed(events.where(s.where(_own)).select(row.alias(s.alias)).withColumn("_t2", F.col(f"{s.alias}.ts")), within_micros, False, "_t2").withColumnRenamed("_bucket", "_bucket2")
        later = F.struct(f"{s.alias}.ts", f"{s.alias}.event_id")
        on = (F.col(f"{first}.{key}") == F.col(f"{s.alias}.{key}")) & (F.col("_bucket") == F.col("_bucket2")) & (later > F.col("_prev")) & (micros("_t2") <= micros("_t") + within_micros)
        out = left.join(right, on).withColumn("_prev", later).drop("_bucket", "_bucket2", "_t", "_t2")
    return out.drop("_prev")


def kleene_tail(starts: DataFrame, candidates: DataFrame, *, key: str, within_micros: int, extra: Column | None = None) -> DataFrame:
    """A match (l, r) for every later candidate within the time."""
    return interval_join(starts, candidates, key=key, within_micros=within_micros, extra=extra)


def both(events: DataFrame, a: Local, b: Local, *, key: str, within_micros: int, order: Sequence[str] = ORDER) -> DataFrame:
    """AND: events of both kinds in either order; each event opens a run that the first later one of the other ends."""
    row = F.struct(*events.columns)
    df = events.withColumns({"_a": _later(F.when(a(_own), row), [key], order), "_b": _later(F.when(b(_own), row), [key], order)})
    df = df.withColumn("second", F.when(a(_own), F.col("_b")).when(b(_own), F.col("_a")))
    return df.where(F.col("second").isNotNull() & (micros("second.ts") <= micros("ts") + within_micros)).select(row.alias("first"), "second")


def ever_rising(events: DataFrame, column: str, *, key: str, order: Sequence[str] = ORDER) -> DataFrame:
    """Longest runs of rising values of a key: first and last event id and length (a Kleene step that compares
    each event with the one before)."""
    spec = Window.partitionBy(key).orderBy(*order)
    df = events.withColumn("_new", F.coalesce((F.col(column) <= F.lag(column).over(spec)).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(spec))
    return df.groupBy(key, "_run").agg(F.min_by("event_id", F.struct(*order)).alias("first_id"), F.max_by("event_id", F.struct(*order)).alias("last_id"), F.count(F.lit(1)).alias("n")).drop("_run")


def flat(matches: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Match structs as columns <alias>_<field>."""
    return matches.select(*[F.col(f"{a}.{f}").alias(f"{a}_{f}") for a, fs in aliases.items() for f in fs])
