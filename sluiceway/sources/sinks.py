"""Sinks by connector: files, console, JDBC and HTTP, and several in one pass, with a dead-letter folder."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

Sink = Callable[[DataFrame], None]


def as_json(df: DataFrame) -> DataFrame:
    """Events as sinks see them: event_type and timestamp first, then the other fields."""
    head = [c for c in ("event_type", "ts") if c in df.columns]
    return df.select(F.to_json(F.struct(*head, *[c for c in df.columns if c not in head])).alias("value"))


def file_sink(path: str, *, mode: str = "append") -> Sink:
    return lambda df: as_json(df).write.mode(mode).text(path)


def format_sink(name: str, options: Mapping[str, str], *, mode: str = "append") -> Sink:
    """Any format that Spark can write: kafka, jdbc, parquet, ..."""
    return lambda df: (as_json(df) if name == "kafka" else df).write.format(name).options(**options).mode(mode).save()


def http_sink(url: str, *, tries: int = 3, timeout: float = 10.0, delay: float = 0.1) -> Sink:
    """Posts each event from the executors, with retries after `delay` seconds, doubled each time; a failure ends the write (see with_dead_letters)."""

    def post(rows: Iterator[Row]) -> None:
        for row in rows:
            request = urllib.request.Request(url, row.value.encode(), {"Content-Type": "application/json"})
            for left in range(tries, 0, -1):
                try:
                    urllib.request.urlopen(request, timeout=timeout).close()
                    break
                except OSError:
                    if left == 1:
                        raise
                    time.sleep(delay * 2 ** (tries - left))

    return lambda df: as_json(df).foreachPartition(post)


def with_dead_letters(sink: Sink, path: str) -> Sink:
    """On failure the events go to the dead-letter folder with the error."""

    def run(df: DataFrame) -> None:
        try:
            sink(df)
        except Exception as error:  # whatever a sink raises
            as_json(df).withColumn("error", F.lit(json.dumps(str(error)[:500]))).write.mode("append").json(path)

    return run


def multi_sink(sinks: Sequence[Sink]) -> Sink:
    """All sinks over one evaluation of the events."""

    def run(df: DataFrame) -> None:
        held = df.persist()
        try:
            for s in sinks:
                s(held)
        finally:
            held.unpersist()

    return run


def sink_for(kind: str, options: Mapping[str, str]) -> Sink:
    """The sink of a connector declaration."""
    if kind == "file":
        return file_sink(options["path"])
    if kind == "console":
        return lambda df: as_json(df).show(truncate=False)
    if kind == "http":
        return http_sink(options["url"])
    return format_sink(kind, options)
