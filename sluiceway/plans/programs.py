"""Queries written in the pipeline language, over the driver's events, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basic
from ..sources.events import read_events
from .catalog import ORACLES, _next, events, forecast_sql, query, rounded_forecast, table
from .lower import Program


def run(spark: SparkSession, d: str, text: str, stream: str, **kw) -> DataFrame:  # noqa: ANN003
    return Program(text, spark, events=events(spark, d), **kw).stream(stream)


@query("SELECT event_id, user_id, round(value * 1.2, 6) AS gross FROM events WHERE event_type = 'purchase' AND value > 50")
def dsl_filter(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        const FLOOR = 50
        stream Big = purchase
            .where(value > FLOOR)
            .emit(event_id: event_id, user_id: user_id, gross: value * 1.2)
    """, "Big").withColumn("gross", F.round("gross", 6))  # fmt: skip


@query(ORACLES["seq_not"])
def dsl_seq_not(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Bought = view as a
            -> purchase where user_id == a.user_id as b
            .within(1d)
            .not(error where user_id == a.user_id)
            .emit(a_id: a.event_id, b_id: b.event_id)
    """, "Bought")  # fmt: skip


@query(ORACLES["seq_condition"])
def dsl_seq_compare(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Dearer = view as a
            -> purchase where user_id == a.user_id and value > a.value as b
            .within(24h)
            .emit(a_id: a.event_id, b_id: b.event_id)
    """, "Dearer")  # fmt: skip


@query(ORACLES["kleene_mid"])
def dsl_pattern(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        pattern Funnel = SEQ(signup as a, view+ as b, purchase as c) within 3d partition by user_id
        stream Found = Funnel.emit(a_id: a.event_id, c_id: c.event_id, b_id: b.event_id, b_count: b_count)
    """, "Found")  # fmt: skip


@query("""SELECT CAST(user_id AS VARCHAR) AS _partition, n, total, spread FROM (SELECT user_id, w_id, count(*) AS n, round(sum(value * 2), 6) AS total, round(max(value) - min(value), 6) AS spread FROM (
 SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS w_id, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE event_type <> 'error')
 WHERE w_id < c // 20 GROUP BY user_id, w_id) WHERE spread > 100""")
def dsl_window(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Calm = merge(stream v = view, stream c = click, stream p = purchase, stream s = signup)
        stream Stats = Calm
            .partition_by(user_id)
            .window(20)
            .aggregate(n: count(), total: sum(value * 2), spread: max(value) - min(value))
            .having(spread > 100)
    """, "Stats").select("_partition", "n", F.round("total", 6).alias("total"), F.round("spread", 6).alias("spread"))  # fmt: skip


@query("SELECT event_id, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS band, user_id // 10 AS decade, round(value * 3 + 1, 6) AS scaled FROM events WHERE event_type = 'click'")
def dsl_udf(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        fn band(v: float) -> str:
            return if v > 100 then "high" else "low"
        fn scaled(v: float) -> float: v * 3 + 1
        stream Bands = click.select(event_id, band: band(value), decade: user_id / 10, scaled: scaled(value))
    """, "Bands").withColumn("scaled", F.round("scaled", 6))  # fmt: skip


@query("SELECT e.user_id * 10 + x.i AS k, CAST(count(*) AS BIGINT) AS n FROM events e, (SELECT unnest([0, 1, 2]) AS i) x WHERE e.event_type = 'signup' AND (x.i < 2 OR e.user_id % 2 = 0) GROUP BY 1")
def dsl_process(spark, d):  # noqa: ANN001, ANN201
    out = run(spark, d, """
        fn spread(user: int):
            for i in 0..3:
                if i < 2:
                    emit Cell(k: user * 10 + i)
                elif user % 2 == 0:
                    emit Cell(k: user * 10 + i)
        stream Cells = signup.process(spread(user_id))
    """, "Cells")  # fmt: skip
    return out.select(F.get_json_object("fields", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(ORACLES["latest_join"])
def dsl_join(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Pairs = join(view, click)
            .on(view.user_id == click.user_id)
            .window(6h)
            .select(key: key, ts: ts, view_value: view.value, click_value: click.value)
    """, "Pairs")  # fmt: skip


@query(ORACLES["trend_count"])
def dsl_trend(spark, d):  # noqa: ANN001, ANN201
    out = run(spark, d, """
        stream Trends = signup as a
            -> all view where user_id == a.user_id as r
            .within(7d)
            .trend_aggregate(n_trends: count_trends())
    """, "Trends")  # fmt: skip
    return out.where("n_trends > 0").select("user_id", "w_start", F.col("n_trends").cast("string").alias("n_trends"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def dsl_enrich(spark, d):  # noqa: ANN001, ANN201
    tables = {"customer": table(spark, d, "customer"), "Nations": table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")}
    return Program("""
        stream Rich = customer
            .where(c_acctbal > 5000)
            .enrich(Nations, key: c_nationkey, fields: [n_name])
            .select(c_custkey, n_name)
    """, spark, tables=tables).stream("Rich")  # fmt: skip


@query(ORACLES["session"])
def dsl_session(spark, d):  # noqa: ANN001, ANN201
    e = events(spark, d)
    return Program("""
        stream Visits = all_events
            .partition_by(user_id)
            .window(session: 12h)
            .aggregate(n: count(), opened: first(ts), closed: last(ts))
    """, spark, tables={"all_events": e}).stream("Visits").withColumn("w_id", F.col("w_id")).select("user_id", "w_id", "n", "opened", "closed")  # fmt: skip


@query(ORACLES["sliding_count"])
def dsl_sliding(spark, d):  # noqa: ANN001, ANN201
    out = Program("""
        stream Last5 = all_events
            .partition_by(user_id)
            .window(5, sliding: 3)
            .aggregate(total: sum(value))
    """, spark, tables={"all_events": events(spark, d)}).stream("Last5")  # fmt: skip
    return out.select("event_id", "user_id", F.round("total", 6).alias("total"))


@query(ORACLES["and_pair"])
def dsl_and(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        pattern Both = signup AND click within 1d partition by user_id
        stream Pairs = Both.select(a_id: first.event_id, b_id: second.event_id)
    """, "Pairs")  # fmt: skip


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1 ORDER BY ts, event_id LIMIT 20")
def dsl_distinct_limit(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, "stream Firsts = purchase.distinct(user_id).limit(20)", "Firsts").select("event_id")


@query("""SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING max(value) > 300) AND event_type = 'purchase'""")
def dsl_lambda(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Rich = purchase
            .partition_by(user_id)
            .pattern(big: es => es.filter(e => e.value > 300).len() > 0)
            .select(event_id)
    """, "Rich")  # fmt: skip


@query("""SELECT a.event_id AS a_id, r.event_id AS b_id FROM events a JOIN events r ON a.user_id = r.user_id AND a.event_type = 'signup' AND r.event_type = 'view'
 AND (r.ts, r.event_id) > (a.ts, a.event_id) AND r.ts <= a.ts + INTERVAL 1 DAY""")
def dsl_kleene_tail(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Seen = signup as a -> all view where user_id == a.user_id as v .within(1d)
            .emit(a_id: a.event_id, b_id: v.event_id)
    """, "Seen")  # fmt: skip


@query(forecast_sql("event_type IN ('view', 'purchase')"))
def dsl_forecast(spark, d):  # noqa: ANN001, ANN201
    return rounded_forecast(run(spark, d, """
        stream Soon = view as v -> purchase where user_id == v.user_id as p
            .within(1d)
            .forecast(confidence: 0.1, max_depth: 1, horizon: 2, warmup: 100)
            .where(forecast_probability > 0.1)
    """, "Soon"))  # fmt: skip


# ---- expressions


@query("""SELECT event_id, user_id % 7 AS m, -(user_id % 7) % 4 AS neg, user_id % 3 = 0 OR value > 100 AS either, (user_id % 3 = 0) <> (value > 100) AS one, NOT value > 100 AS low,
 user_id & 6 AS b_and, user_id | 9 AS b_or, xor(user_id, 5) AS b_xor, user_id << 2 AS up, user_id >> 1 AS down, ~user_id AS flipped, event_type IN ('view', 'click') AS some, user_id BETWEEN 3 AND 9 AS within_, contains(event_type, 'ie') AS held FROM events""")
def dsl_operators(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Out = All.select(event_id, m: user_id % 7, neg: -(user_id % 7) % 4, either: user_id % 3 == 0 or value > 100, one: (user_id % 3 == 0) xor (value > 100), low: not (value > 100),
            b_and: user_id & 6, b_or: user_id | 9, b_xor: user_id ^ 5, up: user_id << 2, down: user_id >> 1, flipped: ~user_id,
            some: event_type in ["view", "click"], within_: user_id in 3..=9, held: "ie" in event_type)
    """, "Out", tables={"All": events(spark, d)})  # fmt: skip


@query("""SELECT event_id, CAST(user_id AS DOUBLE) ** 2 AS squared, CAST((user_id % 5) ** 3 AS BIGINT) AS cubed, CAST(NULL AS BIGINT) AS over, round(value / nullif(user_id % 2, 0), 6) AS halved, coalesce(value / nullif(user_id % 2, 0), -1) > 0 AS filled FROM events""")
def dsl_powers(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Out = All.select(event_id, squared: to_float(user_id) ** 2, cubed: (user_id % 5) ** 3, over: (user_id + 10) ** 30, halved: value / (user_id % 2), filled: (value / (user_id % 2) ?? 0.0 - 1.0) > 0)
    """, "Out", tables={"All": events(spark, d)}).withColumn("halved", F.round("halved", 6))  # fmt: skip


@query("""SELECT event_id, event_type[1] AS a, event_type[-1:] AS z, substr(event_type, 2, 2) AS mid, substr(event_type, 3) AS rest, user_id + 2 AS third, 3::BIGINT AS n, CAST(user_id AS BIGINT) AS head,
 len(range(0, user_id % 5)) AS counted, coalesce(list_sum(range(0, user_id % 5 + 1)), 0)::DOUBLE AS summed, user_id * 2 AS looked FROM events""")
def dsl_index_slice(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Out = All.select(event_id, a: event_type[0], z: event_type[-1], mid: event_type[1:3], rest: event_type[2:], third: [user_id, user_id + 1, user_id + 2][-1], n: len([user_id, 1, 2]),
            head: first([user_id, 1, 2][0:2]), counted: len(0..(user_id % 5)), summed: sum(0..=(user_id % 5)), looked: {"one": user_id, "two": user_id * 2}["two"])
    """, "Out", tables={"All": events(spark, d)})  # fmt: skip


@query("SELECT event_id, round(exp(value / 1000), 9) AS e, round(cos(value), 9) AS co, round(tan(value / 1000), 9) AS ta, CAST(user_id AS VARCHAR) AS s, CAST(trunc(value) AS BIGINT) AS i, CAST(user_id AS DOUBLE) AS f, CAST(NULL AS BIGINT) AS bad, upper(event_type) AS up, lower(upper(event_type)) AS low FROM events")
def fn_numbers_texts(spark, d):  # noqa: ANN001, ANN201
    out = run(spark, d, """
        stream Out = All.select(event_id, e: exp(value / 1000), co: cos(value), ta: tan(value / 1000), s: to_string(user_id), i: to_int(value), f: to_float(user_id), bad: to_int(event_type), up: to_upper(event_type), low: to_lower(to_upper(event_type)))
    """, "Out", tables={"All": events(spark, d)})  # fmt: skip
    return out.withColumns({n: F.round(n, 9) for n in ("e", "co", "ta")})


@query("""SELECT event_id, user_id || ',5,1' AS pushed, CAST(user_id AS VARCHAR) AS popped, user_id || ',9' AS put, 'one,two' AS ks, user_id || ',2' AS vs, 3::BIGINT AS got, '1,2,' || user_id AS flat, '1-' || user_id AS joined, 2::BIGINT AS paired FROM events""")
def fn_collections(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Out = All.select(event_id, pushed: join(push([user_id, 5], 1), ","), popped: join(pop([user_id, 5]), ","), put: join(set([user_id, 5], 1, 9), ","), ks: join(keys({"one": user_id, "two": 2}), ","),
            vs: join(values({"one": user_id, "two": 2}), ","), got: get(set({"one": user_id}, "two", 3), "two"), flat: join(flatten([[1, 2], [user_id]]), ","), joined: join([1, user_id], "-"), paired: len(zip([7, 1], [user_id, 2])))
    """, "Out", tables={"All": events(spark, d)})  # fmt: skip


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 'null' ELSE 'float' END AS tv, 'int' AS tu, 'string' AS te, user_id IS NOT NULL AS i, value IS NOT NULL AS f, event_type IS NOT NULL AS s, true AS b, true AS a, true AS m, false AS no,
 value IS NULL AS missing, coalesce(value, 0.0) AS c, coalesce(value, 1.0) AS d FROM events""")
def fn_types(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Out = All.select(event_id, tv: type_of(value), tu: type_of(user_id), te: type_of(event_type), i: is_int(user_id), f: is_float(value), s: is_string(event_type), b: is_bool(user_id > 3), a: is_array([user_id]),
            m: is_map({"one": user_id}), no: is_int(value), missing: is_null(value), c: coalesce(value, 0.0), d: if_null(value, 1.0))
    """, "Out", tables={"All": events(spark, d)})  # fmt: skip


@query("SELECT event_id, epoch_us(ts) AS us, CAST(hour(ts) AS INT) AS h, CAST(day(ts) AS INT) AS dd, strftime(ts, '%Y-%m') AS month FROM events")
def fn_times(spark, d):  # noqa: ANN001, ANN201
    held = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return run(spark, d, """
        stream Out = All.where(now() > ts).select(event_id, us: timestamp(ts), h: hour(ts), dd: day(ts), month: format(ts, "yyyy-MM"))
    """, "Out", tables={"All": held})  # fmt: skip


# ---- streams


@query("SELECT 'Alert' AS event_type, event_id, value FROM events WHERE event_type = 'error' AND value > 20 AND user_id % 2 = 0")
def dsl_emit_as(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, "stream Out = error.where(value > 20).filter(user_id % 2 == 0).emit as Alert (event_id: event_id, value: value)", "Out")


@query("SELECT event_id, value FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 1")
def dsl_first(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, "stream Out = click.first().select(event_id, value)", "Out")


@query("""SELECT event_id, w_id FROM (SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS w_id, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE event_type = 'view') WHERE w_id < c // 5""")
def dsl_window_only(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, "stream Out = view.partition_by(user_id).window(5)", "Out").select("event_id", F.col("w_id").cast("long").alias("w_id"))


@query("""SELECT a.event_id AS a_id, min_by(b.event_id, (b.ts, b.event_id)) AS b_id FROM (SELECT * FROM events WHERE event_type = 'view' AND value > 50) a
 JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) GROUP BY 1
 HAVING min((b.ts, b.event_id))[1] <= any_value(a.ts) + INTERVAL 1 DAY""")
def dsl_derived_step(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Dear = view.where(value > 50)
        stream Out = Dear as a -> purchase where user_id == a.user_id as b .within(1d) .emit(a_id: a.event_id, b_id: b.event_id)
    """, "Out")  # fmt: skip


_TWO_NOTS = """SELECT a.event_id AS a_id, n.b_id FROM (SELECT * FROM events WHERE event_type = 'view') a JOIN LATERAL (
 SELECT b.event_id AS b_id, b.ts AS b_ts FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) ORDER BY b.ts, b.event_id LIMIT 1) n ON true
 WHERE n.b_ts <= a.ts + INTERVAL 1 DAY AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = a.user_id AND (x.event_type = 'error' OR x.event_type = 'click' AND x.value > 80) AND (x.ts, x.event_id) > (a.ts, a.event_id) AND (x.ts, x.event_id) <= (n.b_ts, n.b_id))"""


@query(_TWO_NOTS)
def dsl_two_nots(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Out = view as a -> purchase where user_id == a.user_id as b .within(1d)
            .not(error where user_id == a.user_id).not(click where user_id == a.user_id and value > 80)
            .emit(a_id: a.event_id, b_id: b.event_id)
    """, "Out")  # fmt: skip


@query("SELECT ts FROM (SELECT unnest(generate_series(min(ts) + INTERVAL 6 HOUR, max(ts), INTERVAL 6 HOUR)) AS ts FROM events)")
def dsl_timer(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, "stream Out = timer(6h).select(ts)", "Out")


@query("SELECT event_id, round(value * 2 + user_id, 6) AS risk FROM events WHERE event_type = 'purchase'")
def dsl_score(spark, d):  # noqa: ANN001, ANN201
    def model():  # noqa: ANN202
        return lambda x: x[:, :1] * 2 + x[:, 1:]

    out = run(spark, d, 'stream Out = purchase.score(model: "risk", inputs: [value, user_id], outputs: [risk]).select(event_id, risk)', "Out", models={"risk": model})
    return out.withColumn("risk", F.round("risk", 6))


@query("""WITH e AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS w FROM events WHERE event_type IN ('signup', 'view', 'purchase')),
t AS (SELECT a.user_id, a.w, power(2, (SELECT count(*) FROM e b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND b.w = a.w AND (b.ts, b.event_id) > (a.ts, a.event_id) AND (b.ts, b.event_id) < (c.ts, c.event_id))) - 1 AS n
 FROM e a JOIN e c ON a.user_id = c.user_id AND a.w = c.w AND a.event_type = 'signup' AND c.event_type = 'purchase' AND (c.ts, c.event_id) > (a.ts, a.event_id))
SELECT user_id, w AS w_start, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1, 2 HAVING sum(n) > 0""")
def dsl_trend_chain(spark, d):  # noqa: ANN001, ANN201
    out = run(spark, d, """
        stream Out = signup as a -> all view where user_id == a.user_id as b -> purchase where user_id == a.user_id as c .within(1d) .trend_aggregate(n: count_trends())
    """, "Out")  # fmt: skip
    return out.where("n > 0").select("user_id", "w_start", F.col("n").cast("long").alias("n"))


@query("""SELECT event_type, total, digits, parts, label FROM (SELECT 'Cell' AS event_type, CAST(user_id % 10 * (user_id % 10 + 1) / 2 AS BIGINT) AS total, CAST(len(CAST(user_id AS VARCHAR)) AS BIGINT) AS digits, 3::BIGINT AS parts, upper('u-' || user_id) AS label FROM events WHERE event_type = 'signup')""")
def dsl_process_loops(spark, d):  # noqa: ANN001, ANN201
    out = run(spark, d, """
        const STEP = 1
        fn gather(user: int):
            var total = 0
            var i = 0
            while true:
                i := i + STEP
                if i > user % 10:
                    break
                if i < 0:
                    continue
                total := total + i
            let parts = split("a,b,c", ",")
            emit Cell(total: total, digits: len(to_string(user)), parts: len(parts), label: upper(concat("u-", user)), none: to_int("x"))
        stream Out = signup.process(gather(user_id))
    """, "Out")  # fmt: skip
    get = lambda n: F.get_json_object("fields", f"$.{n}")
    return out.select("event_type", *[get(n).cast("long").alias(n) for n in ("total", "digits", "parts")], get("label").alias("label"))


@query("SELECT 'S' || i AS name, count(*) FILTER (event_type = 'click' AND user_id % 3 = i) AS n FROM events, (SELECT unnest([0, 1, 2]) AS i) GROUP BY i")
def dsl_declared_in_a_loop(spark, d):  # noqa: ANN001, ANN201
    made = Program("""
for i in 0..3:
    stream S{i} = click.where(user_id % 3 == {i}).select(event_id)
""", spark, events=events(spark, d))  # fmt: skip
    counted = [made.stream(f"S{i}").agg(F.lit(f"S{i}").alias("name"), F.count(F.lit(1)).alias("n")) for i in range(3)]
    return counted[0].unionAll(counted[1]).unionAll(counted[2])


@query(ORACLES["seq2"])
def dsl_sequence_source(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Out = sequence(a: view, b: purchase where user_id == a.user_id).within(1d).emit(a_id: a.event_id, b_id: b.event_id, b_value: b.value)
    """, "Out")  # fmt: skip


@query("SELECT event_id, event_type, user_id, value FROM events WHERE event_type = 'error'")
def sink_and_event_file(spark, d):  # noqa: ANN001, ANN201
    """Written through the connectors of a program, and read back."""
    import tempfile

    path = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp(prefix='sluiceway-')}/sink-{uuid.uuid4().hex}"
    Program(f"""
        connector Out = file(path: "{path}")
        stream Errors = error.select(event_id, event_type, user_id, value).to(Out)
    """, spark, events=events(spark, d)).deliver("Errors")  # fmt: skip
    return spark.read.schema("event_id long, event_type string, user_id long, value double").json(path)


_UNKEYED = """SELECT a.event_id AS a_id, n.event_id AS b_id FROM (SELECT * FROM events WHERE event_type = 'signup' AND value > 20) a JOIN LATERAL (
 SELECT b.event_id, b.ts FROM events b WHERE b.event_type = 'purchase' AND b.value > 60 AND (b.ts, b.event_id) > (a.ts, a.event_id) ORDER BY b.ts, b.event_id LIMIT 1) n ON true WHERE n.ts <= a.ts + INTERVAL 2 HOUR"""


@query(_UNKEYED)
def dsl_unkeyed_sequence(spark, d):  # noqa: ANN001, ANN201
    return run(spark, d, """
        stream Large = signup.where(value > 20)
        stream Out = Large as a -> purchase where value > 60 as b .within(2h).emit(a_id: a.event_id, b_id: b.event_id)
    """, "Out")  # fmt: skip


@query("SELECT event_id, user_id, value, event_type FROM events WHERE event_type IN ('view', 'error')")
def event_file(spark, d):  # noqa: ANN001, ANN201
    """Events written as an event file, a line each, and read back."""
    import tempfile

    path = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp(prefix='sluiceway-')}/evt-{uuid.uuid4().hex}"
    held = events(spark, d).where("event_type IN ('view', 'error')")
    held.select(F.format_string("@0s %s { id: %d, user_id: %d, value: %s }", "event_type", "event_id", "user_id", F.col("value").cast("string"))).write.text(path)
    return read_events(spark, path, {"id": "long", "user_id": "long", "value": "double"}).select(F.col("id").alias("event_id"), "user_id", "value", "event_type")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def enrich_by_shuffle(spark, d):  # noqa: ANN001, ANN201
    out = basic.enrich(table(spark, d, "customer"), table(spark, d, "nation"), key=F.col("c_nationkey"), ref_key="n_nationkey", fields=["n_name"], most_bytes=0)
    return out.select("c_custkey", "c_name", "n_name")
