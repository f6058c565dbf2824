"""Event files and generators.

An event file has a line for each event, `Type { field: value, ... }`, with an optional `@10s` before it or a
`BATCH ms` line in front of several; lines from "{" on are JSON; `#` and `//` start comments. The offset is added
to a base time, the line's number is the event's id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r"^\s*(?:@(\d+)(ms|s|m|h)?\s+)?(\w+)\s*\{(.*)\}\s*;?\s*$"
_FIELD = r'(\w+)\s*:\s*("(?:[^"\\]|\\.)*"|[^,{}]+)'


def read_events(spark: SparkSession, path: str, fields: dict[str, str], *, base: str = "2024-01-01 00:00:00") -> DataFrame:
    """event_type, event_id, ts and the named fields (cast to their types; missing ones null) of an event file.

    A file is read as one text, since BATCH lines hold for what follows; many files are read in parallel.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    lines = raw.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("n")
    batch = F.last(F.regexp_extract("line", r"^\s*BATCH\s+(\d+)", 1).try_cast("long"), ignorenulls=True).over(order)
    rows = lines.withColumn("batch", batch).where(~F.col("line").rlike(r"^\s*(#|//|BATCH\b|$)"))
    unit = F.regexp_extract("line", _LINE, 2)
    at = F.regexp_extract("line", _LINE, 1).try_cast("long") * F.when(unit == "ms", 1).when(unit == "m", 60_000).when(unit == "h", 3_600_000).otherwise(1_000)
    json = F.col("line").rlike(r"^\s*\{")
    body = F.when(~json, F.regexp_extract("line", _LINE, 4))
    names, values = F.regexp_extract_all(body, F.lit(_FIELD), F.lit(1)), F.regexp_extract_all(body, F.lit(_FIELD), F.lit(2))
    kv = F.map_from_arrays(names, F.transform(values, lambda v: F.regexp_replace(F.trim(v), r'^"|"$', "")))

    def value(name: str, kind: str):  # noqa: ANN202
        direct = F.coalesce(F.get_json_object("line", f"$.data.{name}"), F.get_json_object("line", f"$.{name}"))
        return F.nullif(F.when(json, direct).otherwise(F.try_element_at(kv, F.lit(name))), F.lit("null")).try_cast(kind).alias(name)

    ms = F.coalesce(at, F.col("batch"), F.lit(0))
    return rows.select(
        F.when(json, F.coalesce(F.get_json_object("line", "$.event_type"), F.get_json_object("line", "$.type"))).otherwise(F.regexp_extract("line", _LINE, 3)).alias("event_type"),
        F.col("n").cast("long").alias("event_id"),
        (F.to_timestamp_ntz(F.lit(base)) + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))).alias("ts"),
        *[value(n, k) for n, k in fields.items()],
    ).where("event_type <> ''")


def climate(spark: SparkSession, n: int, *, start: str = "2024-01-01 00:00:00", zones: int = 4) -> DataFrame:
    """Generated temperature readings of zones, one a second; the same rows each time."""
    i = F.col("id")
    return spark.range(n).select(
        F.lit("TemperatureReading").alias("event_type"),
        i.alias("event_id"),
        (F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(secs=i.cast("decimal(18,6)"))).alias("ts"),
        F.concat(F.lit("zone"), (i % zones).cast("string")).alias("zone"),
        (21 + 3 * F.sin(i / 600) + (F.pmod(F.xxhash64(i), F.lit(1000)) / 1000 - 0.5)).alias("value"),
    )


def humidity(spark: SparkSession, n: int, *, start: str = "2024-01-01 00:00:00", zones: int = 4) -> DataFrame:
    """Generated humidity readings, one every two seconds."""
    i = F.col("id")
    at = F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(secs=(2 * i).cast("decimal(18,6)"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 45 + 10 * F.cos(i / 400) + F.pmod(F.xxhash64(i, F.lit(7)), F.lit(100)) / 50))
    return spark.range(n).select(F.lit("HumidityReading").alias("event_type"), i.alias("event_id"), at.alias("ts"), F.concat(F.lit("zone"), (i % zones).cast("string")).alias("zone"), value.alias("value"))


def unit_status(spark: SparkSession, n: int, *, start: str = "2024-01-01 00:00:00", units: int = 2) -> DataFrame:
    """Generated status of climate units, one every five seconds."""
    i = F.col("id")
    at = F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(secs=(5 * i).cast("decimal(18,6)"))
    mode = F.when(i % 10 < 6, "cooling").when(i % 10 < 9, "idle").otherwise("heating")
    power = F.when(mode == "idle", 0.2).otherwise(2.5 + F.pmod(F.xxhash64(i, F.lit(9)), F.lit(100)) / 100)
    return spark.range(n).select(F.lit("HVACStatus").alias("event_type"), i.alias("event_id"), at.alias("ts"), F.concat(F.lit("unit"), (i % units).cast("string")).alias("unit_id"), mode.alias("mode"), power.alias("power_consumption"))


def is_event_line(line: str) -> bool:
    return re.match(_LINE, line) is not None
