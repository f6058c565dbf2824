"""Scalar functions of the event language as Column builders. Wrong input gives null, never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG, DOUBLE = "bigint", "double"


def lit(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def int_div(a: Column, b: Column) -> Column:
    """Whole division, truncated; by zero null."""
    q = F.try_divide(a.cast("decimal(38,0)"), F.nullif(b.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast(LONG)


def int_pow(a: Column, b: Column) -> Column:
    """Whole power; null beyond 64 bits."""
    return F.pow(a, b).try_cast(LONG)


def logarithm(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Of zero minus infinity; below zero null, as a NaN is above all numbers here and would pass a filter for large ones."""
    return lambda x: F.when(x == F.lit(0.0), F.lit(float("-inf"))).otherwise(f(x))


def smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def larger(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def text_len(s: Column) -> Column:
    """Bytes of a text."""
    return F.octet_length(s).cast(LONG)


def substring(s: Column, start: Column, end: Column | None = None) -> Column:
    """Characters start to end (exclusive), from 0; null when out of range."""
    start, n = lit(start), F.char_length(s)
    end = n if end is None else lit(end)
    return F.when((start >= 0) & (start <= end) & (end <= n), s.substr((start + 1).cast("int"), (end - start).cast("int")))


def element(a: Column, i: Column) -> Column:
    """Element i from 0; negative counts from the end; null when out of range."""
    i = lit(i)
    return F.try_element_at(a, F.when(i >= 0, i + 1).otherwise(i).cast("int"))


def part(a: Column, lo: Column, hi: Column) -> Column:
    """Elements lo to hi (exclusive), clamped."""
    n = F.size(a)
    lo, hi = F.greatest(F.lit(0), F.least(lit(lo), n)), F.greatest(F.lit(0), F.least(lit(hi), n))
    return F.slice(a, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))


def number_range(a: Column, b: Column, *, closed: bool = False) -> Column:
    """a, a + 1, ... below b (closed: up to b); empty if there is none."""
    a, b = lit(a).cast(LONG), lit(b).cast(LONG)
    b = b if closed else b - 1
    return F.when(a <= b, F.sequence(a, F.greatest(a, b))).when(a > b, F.array().cast("array<bigint>"))


def pop(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1))


def set_at(a: Column, i: Column, v: Column) -> Column:
    """The array with element i replaced; unchanged when out of range."""
    return F.transform(a, lambda x, j: F.when(j == lit(i), lit(v)).otherwise(x))


def array_sum(a: Column) -> Column:
    return F.aggregate(F.filter(F.transform(a, lambda x: x.try_cast(DOUBLE)), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)


def array_avg(a: Column) -> Column:
    values = F.filter(F.transform(a, lambda x: x.try_cast(DOUBLE)), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, array_sum(a) / F.size(values)).otherwise(F.lit(0.0))


def array_variance(a: Column) -> Column:
    """Population variance."""
    mean = array_avg(a)
    return F.when(F.size(a) > 0, F.aggregate(F.transform(a, lambda x: (x.try_cast(DOUBLE) - mean) ** 2), F.lit(0.0), lambda s, x: s + x) / F.size(a))


def sliding_pairs(a: Column) -> Column:
    """Neighbours as two-element arrays."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), lambda x, y: F.array(x, y))


def split(s: Column, sep: Column) -> Column:
    """Parts between occurrences of a literal separator."""
    quoted = F.concat(F.lit(r"\Q"), lit(sep), F.lit(r"\E"))
    return F.split(s, quoted, -1)


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lit(lo), F.least(lit(hi), x))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def to_int(v: Column) -> Column:
    return v.try_cast(LONG)


def to_float(v: Column) -> Column:
    return v.try_cast(DOUBLE)


def replace(s: Column, old: object, new: object) -> Column:
    return F.replace(s, lit(old), lit(new))


#: By name: (least arguments, most arguments, builder).
TABLE: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "abs": (1, 1, F.abs), "sqrt": (1, 1, F.sqrt), "floor": (1, 1, lambda x: F.floor(x).cast(LONG)), "ceil": (1, 1, lambda x: F.ceil(x).cast(LONG)),
    "round": (1, 1, lambda x: F.round(x).cast(LONG)), "pow": (2, 2, F.pow), "log": (1, 1, logarithm(F.ln)), "log10": (1, 1, logarithm(F.log10)), "exp": (1, 1, F.exp),
    "sin": (1, 1, F.sin), "cos": (1, 1, F.cos), "tan": (1, 1, F.tan), "min": (2, 2, smaller), "max": (2, 2, larger), "clamp": (3, 3, clamp),
    "len": (1, 1, text_len), "size": (1, 1, lambda a: F.size(a).cast(LONG)), "first": (1, 1, lambda a: F.try_element_at(a, F.lit(1))), "last": (1, 1, lambda a: F.try_element_at(a, F.lit(-1))),
    "push": (2, 2, F.array_append), "pop": (1, 1, pop), "reverse": (1, 1, F.reverse), "sort": (1, 1, F.array_sort), "keys": (1, 1, F.map_keys), "values": (1, 1, F.map_values),
    "get": (2, 2, element), "set": (3, 3, set_at), "range": (1, 2, lambda a, b=None: number_range(F.lit(0), a) if b is None else number_range(a, b)),
    "sum": (1, 1, array_sum), "avg": (1, 1, array_avg), "variance": (1, 1, array_variance), "to_string": (1, 1, lambda v: v.cast("string")), "to_int": (1, 1, to_int), "to_float": (1, 1, to_float),
    "trim": (1, 1, trim), "lower": (1, 1, F.lower), "lowercase": (1, 1, F.lower), "to_lower": (1, 1, F.lower), "upper": (1, 1, F.upper), "uppercase": (1, 1, F.upper), "to_upper": (1, 1, F.upper),
    "replace": (3, 3, replace), "starts_with": (2, 2, F.startswith), "ends_with": (2, 2, F.endswith), "substring": (2, 3, substring), "contains": (2, 2, F.contains),
    "array_contains": (2, 2, F.array_contains), "is_null": (1, 1, F.isnull), "concat": (1, 99, F.concat), "coalesce": (1, 99, F.coalesce), "if_null": (2, 2, F.nvl),
    "unique": (1, 1, F.array_distinct), "flatten": (1, 1, F.flatten), "zip": (2, 2, F.arrays_zip), "split": (2, 2, split), "join": (2, 2, lambda a, s: F.call_function("array_join", F.transform(a, lambda x: x.cast("string")), lit(s))),
    "now": (0, 0, F.current_timestamp), "timestamp": (1, 1, F.unix_micros), "hour": (1, 1, F.hour), "day": (1, 1, F.dayofmonth), "format": (2, 2, lambda t, f: F.call_function("date_format", t, lit(f))),
}
