"""Event files, sinks, and streaming queries against the batch plans."""

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import joins, patterns
from sluiceway.operators.patterns import Step, of_type
from sluiceway.sources import events as E
from sluiceway.sources import sinks
from sluiceway.streaming import queries as S

from .conftest import SMALL


def test_event_file(spark, tmp_path):
    (tmp_path / "a.evt").write_text('# comment\nLogin { user: "ann, b", n: 3 }\n@10s Login { user: bob, n: x }\nBATCH 500\nPay { amount: 2.5 }\n{"event_type": "Pay", "data": {"amount": 4}}\n')
    got = E.read_events(spark, str(tmp_path / "a.evt"), {"user": "string", "n": "long", "amount": "double"}).orderBy("event_id").collect()
    assert [(r.event_type, r.user, r.n, r.amount, r.ts.second, r.ts.microsecond) for r in got] == [("Login", "ann, b", 3, None, 0, 0), ("Login", "bob", None, None, 10, 0), ("Pay", None, None, 2.5, 0, 500000), ("Pay", None, None, 4.0, 0, 500000)]


def test_generator_is_repeatable(spark):
    assert E.climate(spark, 50).collect() == E.climate(spark, 50).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "A")], "x long, event_type string")
    sinks.multi_sink([sinks.file_sink(str(tmp_path / "one")), sinks.file_sink(str(tmp_path / "two"))])(df)
    assert spark.read.text(str(tmp_path / "one")).first().value == '{"event_type":"A","x":1}'

    def fails(_):
        raise OSError("down")

    sinks.with_dead_letters(fails, str(tmp_path / "dead"))(df)
    assert "down" in spark.read.json(str(tmp_path / "dead")).first().error


@pytest.fixture
def source(spark, tmp_path):
    df = spark.read.parquet(f"{SMALL}/events.parquet").where("user_id < 8")
    for lo, hi in ((1, 10), (11, 20), (21, 31)):  # files in the order of time, rows within them in any
        df.where(F.dayofmonth("ts").between(lo, hi)).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_streaming_windows_equal_batch(spark, source, tmp_path):
    batch, live = source
    got = {(r.w_start, r.event_type): r.n for r in drain(spark, S.tumbling(S.on_time(live, "1 day"), "1 day", "event_type", n=F.count(F.lit(1))), tmp_path, "w").collect()}
    whole = {(r.w_start, r.event_type): r.n for r in batch.groupBy(F.window("ts", "1 day").start.alias("w_start"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(got) > 50 and all(whole[k] == n for k, n in got.items())


def test_streaming_sequences_equal_batch(spark, source, tmp_path):
    batch, live = source
    steps = ["view", "click", "purchase"]
    day = 86_400_000_000
    got = {tuple(r.ids) for r in drain(spark, S.sequence(S.on_time(live, "1 day"), steps, key="user_id", within_micros=3 * day, unless="error"), tmp_path, "m").collect()}
    made = patterns.sequence(batch, [Step(f"s{k}", of_type(t)) for k, t in enumerate(steps)], key="user_id", within_micros=3 * day, unless=of_type("error"))
    whole = {tuple(r) for r in made.select(*[F.col(f"s{k}.event_id") for k in range(3)]).collect()}
    assert got and got <= whole and len(got) >= 0.5 * len(whole)


def test_streaming_latest_join_equals_batch(spark, source, tmp_path):
    batch, live = source
    window = 12 * 3_600_000_000
    made = S.latest_join(S.on_time(live, "1 day"), ["view", "click"], key="user_id", window_micros=window)
    got = {(r.key, tuple(r.ids)) for r in drain(spark, made, tmp_path, "j").collect()}
    whole = joins.latest_join({t: (batch.where(F.col("event_type") == t), "user_id") for t in ("view", "click")}, window_micros=window)
    want = {(r.key, (r.view.event_id, r.click.event_id)) for r in whole.collect()}
    assert got and got <= want and len(got) >= 0.5 * len(want)
