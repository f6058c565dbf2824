"""Window aggregates with the semantics of the event language: missing and NaN inputs are skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import ORDER

EMA_PERIOD = 12


def number(x: Column) -> Column:
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def count() -> Column:
    return F.count(F.lit(1))


def total(x: Column) -> Column:
    """The sum as a plain aggregate, null when there is nothing to add; for frames."""
    return F.sum(number(x))


def sum_(x: Column) -> Column:
    return F.coalesce(total(x), F.lit(0.0))


def avg(x: Column) -> Column:
    return F.avg(number(x))


def min_(x: Column) -> Column:
    return F.min(number(x))


def max_(x: Column) -> Column:
    return F.max(number(x))


def stddev(x: Column) -> Column:
    """Sample deviation, null below two values; NaN is not skipped."""
    return F.stddev_samp(x.try_cast("double"))


def first(x: Column, order: Sequence[str] = ORDER) -> Column:
    return F.min_by(F.struct(x.alias("v")), F.struct(*order))["v"]


def last(x: Column, order: Sequence[str] = ORDER) -> Column:
    return F.max_by(F.struct(x.alias("v")), F.struct(*order))["v"]


def count_distinct(x: Column) -> Column:
    return F.count_distinct(x)


def ema(x: Column, n: int = EMA_PERIOD, order: Sequence[str] = ORDER) -> Column:
    """Exponential moving average over the group in order, seeded with the first value; for groups of a window's size."""
    return _folded(F.transform(F.array_sort(F.collect_list(F.when(number(x).isNotNull(), F.struct(*order, number(x).alias("v"))))), lambda s: s["v"]), n)


def _folded(values: Column, n: int) -> Column:
    k = 2.0 / (n + 1)
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(v * F.lit(k) + a * F.lit(1 - k)))


def divide(a: Column, b: Column, *, whole: bool = False) -> Column:
    """Aggregate division: by zero whole numbers give 0, floats NaN."""
    if whole:
        return F.when(b == 0, F.lit(0).cast("long")).otherwise((a / b).cast("long"))
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / b)


#: Aggregates over an ordered frame, by name: functions of the arguments and the frame.
FRAMED = {
    "count": lambda frame, *x: F.count(F.lit(1)).over(frame),
    "sum": lambda frame, x: F.coalesce(total(x).over(frame), F.lit(0.0)),
    "avg": lambda frame, x: avg(x).over(frame),
    "min": lambda frame, x: min_(x).over(frame),
    "max": lambda frame, x: max_(x).over(frame),
    "stddev": lambda frame, x: stddev(x).over(frame),
    "first": lambda frame, x: F.first(x).over(frame),
    "last": lambda frame, x: F.last(x).over(frame),
    "count_distinct": lambda frame, x: F.size(F.collect_set(x).over(frame)).cast("long"),
    "ema": lambda frame, x, n=EMA_PERIOD: _folded(F.collect_list(number(x)).over(frame), n),
}
