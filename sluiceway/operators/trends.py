"""Trend aggregation: counts and sums over all matches of `a -> all b`, without listing them.

With c(e) the number of trends that end in e, c(e) = (1 if e starts) + sum of c over its predecessors. In event
order one running sum for each position of the pattern suffices, so a window costs time linear in its events and
the memory of those sums, however many events it has. Counts are exact up to 38 digits, beyond they are null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .basic import ORDER
from .scan import fold

KIND, MOST = "decimal(38,0)", 10**38


def _exact(n: int):  # noqa: ANN202
    from decimal import Decimal

    return Decimal(n) if n < MOST else None


def _float(n: int) -> float:
    return float(n) if n < 10**300 else math.inf


def trends(events: DataFrame, start: Column, repeat: Column, value: Column, *, by: list[str]) -> DataFrame:
    """For each group: n_trends, n_events (of the repeated step over all trends), sum_values, avg_value, min_value,
    max_value over all trends `start -> all repeat`. The sum is a double, null once a trend holds no value.
    """
    rows = events.select(*by, *ORDER, F.when(start, 0).when(repeat, 1).alias("_kind"), value.cast("double").alias("_v"))

    def step(s: list, kind: int | None, v: float | None) -> None:
        if kind == 0:
            s[0] += 1
        elif kind == 1:
            c = s[0] + s[1]  # trends that end here: those of the starts and of the repeats so far, each lengthened
            s[1] += c
            s[2] += s[2] + c
            s[3] = None if s[3] is None or v is None else s[3] + s[3] + _float(c) * v
            if c and v is not None:
                s[4], s[5] = v if s[4] is None else min(s[4], v), v if s[5] is None else max(s[5], v)

    def done(s: list) -> Sequence[object]:
        return _exact(s[1]), _exact(s[2]), s[3], s[3] / _float(s[2]) if s[2] and s[3] is not None else None, s[4], s[5]

    return fold(rows, by, lambda: [0, 0, 0, 0.0, None, None], step, done, f"n_trends {KIND}, n_events {KIND}, sum_values double, avg_value double, min_value double, max_value double")


def many_trends(events: DataFrame, patterns: dict[str, tuple[Column, Column]], *, by: list[str]) -> DataFrame:
    """n_<name> for each of several patterns `start -> all repeat`: one shuffle serves all of them."""
    rows = events.select(*by, *ORDER, *[F.when(a, 0).when(b, 1).alias(f"_p{k}") for k, (a, b) in enumerate(patterns.values())])
    n = len(patterns)

    def step(s: list, *kinds: int | None) -> None:
        for k, kind in enumerate(kinds):
            if kind == 0:
                s[k] += 1
            elif kind == 1:
                s[n + k] += s[k] + s[n + k]

    return fold(rows, by, lambda: [0] * (2 * n), step, lambda s: [_exact(x) for x in s[n:]], ", ".join(f"`n_{name}` {KIND}" for name in patterns))


def chain_trends(events: DataFrame, steps: list[tuple[str, Column, bool]], *, by: list[str], count: list[str] | None = None) -> DataFrame:
    """n_trends, and n_<alias> for the steps of `count`: trends over a chain of steps (alias, condition, repeated), every event in one step at most (the first that fits).

    An event of a step lengthens every trend of the step before, and of its own step where that repeats; of a
    first step it starts one as well. Each step keeps a running sum of the trends that end in it, and one of the
    events each counted step has in them.
    """
    aliases, counted = [a for a, *_ in steps], list(dict.fromkeys(count or []))
    kind = F.lit(None).cast("int")
    for k, (_, cond, _) in reversed(list(enumerate(steps))):
        kind = F.when(cond, k).otherwise(kind)
    rows, repeats, at = events.select(*by, *ORDER, kind.alias("_kind")), [r for *_, r in steps], [aliases.index(a) for a in counted]
    n = len(steps)

    def step(s: list, k: int | None) -> None:
        if k is None:
            return
        ends, held = s
        more = (ends[k - 1] if k else 1) + (ends[k] if repeats[k] else 0)
        ends[k] += more
        for c, own in enumerate(at):
            sums = held[c]
            sums[k] += (sums[k - 1] if k else 0) + (sums[k] if repeats[k] else 0) + (more if own == k else 0)

    def done(s: list) -> Sequence[object]:
        return [_exact(s[0][-1]), *[_exact(sums[-1]) for sums in s[1]]]

    return fold(rows, by, lambda: [[0] * n, [[0] * n for _ in at]], step, done, ", ".join([f"n_trends {KIND}", *[f"`n_{a}` {KIND}" for a in counted]]))
