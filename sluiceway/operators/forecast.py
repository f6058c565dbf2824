"""Pattern forecasting: a suffix tree of event types, and the chance that a started pattern completes."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .basic import ORDER
from .windows import micros

ALPHA, DEPTH, STEPS, CONVERGED = 0.01, 3, 50, 1e-10


def suffix_counts(events: DataFrame, *, key: str, depth: int = DEPTH, column: str = "event_type", order: Sequence[str] = ORDER) -> DataFrame:
    """context (the types before, oldest first, up to depth of them), symbol, n: the counts of the suffix tree."""
    spec = Window.partitionBy(key).orderBy(*order)
    before = events.withColumns({f"_l{d}": F.lag(column, d).over(spec) for d in range(1, depth + 1)})
    contexts = F.array(*[F.array(*[F.col(f"_l{d}") for d in range(n, 0, -1)]) if n else F.array().cast("array<string>") for n in range(depth + 1)])
    whole = F.filter(contexts, lambda c: ~F.exists(c, lambda x: x.isNull()))
    return before.select(F.explode(whole).alias("context"), F.col(column).alias("symbol")).groupBy("context", "symbol").agg(F.count(F.lit(1)).alias("n"))


class SuffixTree:
    """Counts by context; probabilities smoothed by Laplace's rule over the alphabet. The tree is bounded by alphabet ** depth."""

    def __init__(self, counts: Mapping[tuple[tuple[str, ...], str], int], alpha: float = ALPHA):
        self.counts: dict[tuple[str, ...], dict[str, int]] = {}
        for (context, symbol), n in counts.items():
            self.counts.setdefault(context, {})[symbol] = n
        self.alphabet, self.alpha = sorted({s for _, s in counts}), alpha

    def predict(self, context: Sequence[str]) -> dict[str, float]:
        """Chances of the next type after the longest known suffix of the context."""
        c = tuple(context)
        while c and c not in self.counts:
            c = c[1:]
        own = self.counts.get(c, {})
        total = sum(own.values()) + self.alpha * len(self.alphabet)
        return {s: (own.get(s, 0) + self.alpha) / total for s in self.alphabet} if total else {}

    def completion(self, steps: Sequence[str], context: Sequence[str], horizon: int = STEPS) -> float:
        """Chance that the steps occur in this order within the horizon, other types in between allowed."""
        depth = max((len(c) for c in self.counts), default=0)
        state = {(0, tuple(context)[len(context) - depth :] if depth else ()): 1.0}
        done = 0.0
        for _ in range(horizon):
            new: dict[tuple[int, tuple[str, ...]], float] = {}
            gained = 0.0
            for (k, c), p in state.items():
                for s, q in self.predict(c).items():
                    j = k + (s == steps[k])
                    if j == len(steps):
                        gained += p * q
                    else:
                        at = (j, ((*c, s))[-depth:] if depth else ())
                        new[at] = new.get(at, 0.0) + p * q
            done += gained
            state = new
            if sum(state.values()) < CONVERGED:
                break
        return min(1.0, done)


def learn(events: DataFrame, *, key: str, depth: int = DEPTH, column: str = "event_type", most: int = 200_000) -> SuffixTree:
    """The tree of all events; the driver gets its nodes, at most `most` of them."""
    rows = suffix_counts(events, key=key, depth=depth, column=column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the suffix tree is too large; lower the depth")
    return SuffixTree({(tuple(r.context), r.symbol): r.n for r in rows})


def _completed(column: str, steps: Sequence[str], following: Column) -> Column:
    """1 if the steps occur in this order among the following types, else 0."""
    wanted = F.array(*[F.lit(s) for s in steps])
    reached = F.aggregate(following, F.lit(0), lambda k, x: F.when(x == F.get(wanted, k), k + 1).otherwise(k))
    return (reached == len(steps)).cast("int")


def forecast(
    events: DataFrame, steps: Sequence[str], *, key: str, confidence: float = 0.5, depth: int = DEPTH, horizon: int = STEPS, learned: float = 0.5, warmup: int = 0, coverage: float | None = 0.9,
    column: str = "event_type", order: Sequence[str] = ORDER,
) -> DataFrame:
    """For each event of the first step: the chance that the others follow within `horizon` events, if it reaches the confidence.

    Nothing is learned from what comes later: chances, gaps and errors are those of the first part of the time that
    the events span (`learned` of it), and only events after that part get a forecast; none do if it holds fewer
    than `warmup` events. Chances are computed once for each context, then joined to the events.

    forecast_time: expected seconds to completion, from the mean gap between a key's events. forecast_lower and
    forecast_upper: the chance less and plus the error that `coverage` of the starts learned from stay within (null
    where coverage is None).
    """
    at = micros("ts")
    new = "forecast_probability double, forecast_context_depth int, forecast_state string, forecast_time double, forecast_lower double, forecast_upper double"
    span = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    until = 0 if span.lo is None else int(span.lo + (span.hi - span.lo) * learned)
    past = events.where(at <= until)
    if span.lo is None or past.limit(max(1, warmup)).count() < max(1, warmup):
        return events.limit(0).select("*", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in new.split(", ")])
    tree = learn(past, key=key, depth=depth, column=column)
    spark, spec = events.sparkSession, Window.partitionBy(key).orderBy(*order)
    gap = past.select((at - F.lag(at).over(spec)).alias("gap")).agg(F.avg("gap")).first()[0] or 0.0
    contexts = sorted({c for c in tree.counts if c and c[-1] == steps[0]} | {(steps[0],)})
    rows = [(list(c), float(tree.completion(steps[1:], c, horizon)), len(c), float(waiting_time(tree, steps[1:], c, gap / 1e6))) for c in contexts]
    chances = spark.createDataFrame(rows, "context array<string>, forecast_probability double, forecast_context_depth int, forecast_time double")

    def started(df: DataFrame) -> DataFrame:
        lags = [F.lag(column, d).over(spec) for d in range(depth - 1, 0, -1)]
        marked = df.withColumns({"context": F.filter(F.array(*lags, F.col(column)), lambda x: x.isNotNull()), "_next": F.collect_list(column).over(spec.rowsBetween(1, horizon))})
        return marked.where(F.col(column) == steps[0]).join(F.broadcast(chances), "context", "left")

    half = F.lit(None).cast("double")
    if coverage is not None:
        errors = started(past).select(F.abs(_completed(column, steps[1:], F.col("_next")) - F.col("forecast_probability")).alias("e"))
        half = F.lit(errors.agg(F.percentile_approx("e", coverage, 10_000)).first()[0]).cast("double")
    found = started(events).where((at > until) & (F.col("forecast_probability") >= confidence))
    chance = F.col("forecast_probability")
    return found.select(
        *events.columns, "forecast_probability", "forecast_context_depth", F.lit(steps[0]).alias("forecast_state"), "forecast_time",
        F.greatest(F.lit(0.0), chance - half).alias("forecast_lower") if coverage is not None else half.alias("forecast_lower"),
        F.least(F.lit(1.0), chance + half).alias("forecast_upper") if coverage is not None else half.alias("forecast_upper"),
    )


def pruned(tree: SuffixTree, least: float = 0.05) -> SuffixTree:
    """The tree without contexts whose predictions differ from their shorter context's by less than `least` (KL divergence)."""
    import math

    kept = {(c, s): n for c, own in tree.counts.items() for s, n in own.items() if len(c) < 2 or sum(p * math.log(p / tree.predict(c[1:])[s2]) for s2, p in tree.predict(c).items()) >= least}
    return SuffixTree(kept, tree.alpha)


def waiting_time(tree: SuffixTree, steps: Sequence[str], context: Sequence[str], mean_gap: float) -> float:
    """Expected time to completion: the steps left over the chance of the next one, in mean gaps between events."""
    chance = tree.predict(context).get(steps[0], 0.0)
    return len(steps) / chance * mean_gap if chance else float("inf")


def hawkes(gaps: Sequence[float], *, mu: float, alpha: float, beta: float) -> list[float]:
    """Intensity after each event: mu + (before - mu + alpha) decayed over the gap that follows."""
    import math

    return list(functools.reduce(lambda out, g: [*out, mu + (out[-1] - mu + alpha) * math.exp(-beta * g)], gaps, [mu]))


def conformal(scores: Sequence[float], coverage: float = 0.9, window: int = 1000) -> float:
    """Half width of the interval that covers this share of the last scores (absolute errors)."""
    import math

    held = sorted(scores[-window:])
    return held[min(len(held) - 1, math.ceil((len(held) + 1) * coverage) - 1)] if held else float("inf")
