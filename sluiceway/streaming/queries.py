"""The operators on Structured Streaming: native windows where they fit, keyed state where order matters.

Sequence steps run in transformWithStateInPandas: events wait until the watermark has passed them, then go
through the runs in (ts, event_id) order, so the matches do not depend on arrival order and equal the batch
plan's. State of a key holds the waiting events and the open runs that the time limit still allows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship


def on_time(events: DataFrame, lateness: str, allowed: str | None = None) -> DataFrame:
    """Events with a watermark on ts (as a timestamp with zone, which watermarks need)."""
    delay = lateness if allowed is None else f"{lateness} {allowed}"
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, size: str, *by: str, **aggs) -> DataFrame:  # noqa: ANN003
    return events.groupBy(F.window("ts", size), *by).agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("window.start").alias("w_start"), *by, *aggs)


def sessions(events: DataFrame, gap_micros: int, *by: str, **aggs) -> DataFrame:  # noqa: ANN003
    """A pause of more than the gap parts sessions; Spark's own part at equality, so theirs is a microsecond longer."""
    gap = f"{gap_micros + 1} microseconds"
    return events.groupBy(F.session_window("ts", gap), *by).agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("session_window.start").alias("opened"), *by, *aggs)


def first_of_each(events: DataFrame, *keys: str) -> DataFrame:
    """Drops repeats of the keys within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


class Runs(StatefulProcessor):
    """Greedy sequences of event types within a time limit, with negation."""

    def __init__(self, steps: Sequence[str], within_micros: int, unless: str | None):
        self.steps, self.within, self.unless = list(steps), within_micros, unless

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, event_type string")
        self.runs = handle.getListState("runs", "ids array<long>, start long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        low = None
        for pdf in rows:
            for us, i, kind in zip((pdf["us"]).tolist(), pdf["event_id"].tolist(), pdf["event_type"].tolist(), strict=True):
                self.waiting.appendValue((us, i, kind))
                low = us if low is None else min(low, us)
        if low is not None:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, low // 1000 + 1))
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "ids": pd.Series([], dtype=object)})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready, left = [x for x in held if x[0] <= mark], [x for x in held if x[0] > mark]
        runs = [(list(r[0]), r[1]) for r in self.runs.get()] if self.runs.exists() else []
        done = []
        for us, i, kind in ready:
            runs = [r for r in runs if us <= r[1] + self.within]
            if self.unless is not None and kind == self.unless:
                runs = []
            moved = []
            for ids, start in runs:
                if kind == self.steps[len(ids)]:
                    if len(ids) + 1 == len(self.steps):
                        done.append([*ids, i])
                        continue
                    ids = [*ids, i]
                moved.append((ids, start))
            runs = moved + ([([i], us)] if kind == self.steps[0] else [])
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, left[0][0] // 1000 + 1))
        self.runs.clear()
        if runs:
            self.runs.put([(ids, start) for ids, start in runs])
        if done:
            yield pd.DataFrame({"key": [str(key[0])] * len(done), "ids": done})

    def close(self) -> None:
        pass


class Latest(StatefulProcessor):
    """The latest event of every source within the window, on each arrival in event order."""

    def __init__(self, sources: Sequence[str], window_micros: int):
        self.sources, self.window = list(sources), window_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, src string")
        self.last = handle.getMapState("last", "src string", "us long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        low = None
        for pdf in rows:
            for us, i, src in zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["src"].tolist(), strict=True):
                self.waiting.appendValue((us, i, src))
                low = us if low is None else min(low, us)
        if low is not None:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, low // 1000 + 1))
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "us": pd.Series([], dtype="int64"), "ids": pd.Series([], dtype=object)})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        last = {s: tuple(self.last.getValue((s,))) for s in self.sources if self.last.containsKey((s,))}
        out = []
        for us, i, src in (x for x in held if x[0] <= mark):
            last[src] = (us, i)
            if len(last) == len(self.sources) and all(at >= us - self.window for at, _ in last.values()):
                out.append((str(key[0]), us, [last[s][1] for s in self.sources]))
        left = [x for x in held if x[0] > mark]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, left[0][0] // 1000 + 1))
        for s, v in last.items():
            self.last.updateValue((s,), v)
        if out:
            yield pd.DataFrame(out, columns=["key", "us", "ids"])

    def close(self) -> None:
        pass


def latest_join(events: DataFrame, sources: Sequence[str], *, key: str, window_micros: int, source: str = "event_type") -> DataFrame:
    """key, us (of the arrival), ids: the event ids of the latest event of each source, in their order."""
    ship(events.sparkSession)
    rows = events.where(F.col(source).isin(list(sources))).select(F.col(key).alias("key"), F.unix_micros("ts").alias("us"), "ts", "event_id", F.col(source).alias("src"))
    return rows.groupBy("key").transformWithStateInPandas(Latest(sources, window_micros), "key string, us long, ids array<long>", "Append", "EventTime")


def sequence(events: DataFrame, steps: Sequence[str], *, key: str, within_micros: int, unless: str | None = None) -> DataFrame:
    """key, ids: the event ids of each match. `events` has a watermark; the session uses the RocksDB state store."""
    ship(events.sparkSession)
    rows = events.select(F.col(key).alias("key"), F.unix_micros("ts").alias("us"), "ts", "event_id", "event_type")
    return rows.groupBy("key").transformWithStateInPandas(Runs(steps, within_micros, unless), "key string, ids array<long>", "Append", "EventTime")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
