"""The registered queries of the event engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import basic, forecast, joins, patterns, scoring, trends, windows
from ..operators.patterns import Step, of_type

HOUR, DAY = 3_600_000_000, 86_400_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


c = F.col


# ---- rows

@query("SELECT event_id, user_id, value FROM events WHERE value > 50")
def filter_emit(spark, d):  # noqa: ANN001, ANN201
    return basic.emit(basic.where(events(spark, d), c("value") > 50), event_id=c("event_id"), user_id=c("user_id"), value=c("value"))


@query("SELECT event_id, value * 2 AS doubled, upper(event_type) AS kind FROM events WHERE event_type <> 'error'")
def select_expr(spark, d):  # noqa: ANN001, ANN201
    return basic.select(basic.where(events(spark, d), c("event_type") != "error"), "event_id", doubled=c("value") * 2, kind=F.upper("event_type"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def distinct_first(spark, d):  # noqa: ANN001, ANN201
    return basic.distinct_first(events(spark, d), "user_id", "event_type").select("event_id", "user_id", "event_type")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def limit_first_n(spark, d):  # noqa: ANN001, ANN201
    return basic.limit_first(events(spark, d), 100).select("event_id", "ts")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def order_by_top(spark, d):  # noqa: ANN001, ANN201
    return basic.order_by(events(spark, d), F.desc("value"), "event_id", n=25).select("event_id", "value")


@query("SELECT event_id, event_type, value FROM events WHERE (event_type = 'purchase' AND value > 100) OR event_type = 'signup'")
def merge_filtered(spark, d):  # noqa: ANN001, ANN201
    e = events(spark, d)
    return basic.merge((e, (c("event_type") == "purchase") & (c("value") > 100)), (e, c("event_type") == "signup")).select("event_id", "event_type", "value")


@query("SELECT 'Timer_t' AS event_type, ts, CAST(epoch_ms(ts) AS BIGINT) AS timestamp FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 01:00:00', TIMESTAMP '2024-01-02 00:00:00', INTERVAL 1 HOUR)) AS ts)")
def timer_ticks(spark, d):  # noqa: ANN001, ANN201
    return basic.timer(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "1 HOUR", name="Timer_t")


@query("SELECT c_custkey, c_nationkey, n_name, CASE WHEN n_nationkey IS NULL THEN 'error' ELSE 'ok' END AS enrich_status FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def enrich_nation(spark, d):  # noqa: ANN001, ANN201
    out = basic.enrich(table(spark, d, "customer"), table(spark, d, "nation"), key=c("c_nationkey"), ref_key="n_nationkey", fields=["n_name"], fallback={"n_name": None})
    return out.select("c_custkey", "c_nationkey", "n_name", "enrich_status")


# ---- aggregates

@query("""SELECT user_id, count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS low, max(value) AS high,
 round(stddev_samp(value), 6) AS dev, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def agg_basic(spark, d):  # noqa: ANN001, ANN201
    v = c("value")
    return events(spark, d).groupBy("user_id").agg(A.count().alias("n"), F.round(A.sum_(v), 6).alias("total"), F.round(A.avg(v), 9).alias("mean"), A.min_(v).alias("low"), A.max_(v).alias("high"), F.round(A.stddev(v), 6).alias("dev"), A.count_distinct(c("event_type")).alias("kinds"))


ORACLES["agg_basic"] = ORACLES["agg_basic"].replace("sum(value)", "round(sum(value), 6)").replace("avg(value)", "round(avg(value), 9)")


@query("""SELECT CAST(user_id AS VARCHAR) AS _partition, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value,
 arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id""")
def agg_first_last(spark, d):  # noqa: ANN001, ANN201
    out = events(spark, d).groupBy("user_id").agg(A.first(c("value")).alias("first_value"), A.last(c("value")).alias("last_value"), A.last(c("event_type")).alias("last_type"))
    return out.select(windows.partition_label(c("user_id")), "first_value", "last_value", "last_type")


@query("""SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: x * (2.0::DOUBLE / 13) + a * (1 - 2.0::DOUBLE / 13)), 6) AS ema12 FROM events GROUP BY user_id""")
def agg_ema(spark, d):  # noqa: ANN001, ANN201
    return events(spark, d).groupBy("user_id").agg(F.round(A.ema(c("value"), 12), 6).alias("ema12"))


@query("""SELECT event_type, round(max(value) - min(value), 6) AS spread, CASE WHEN count(*) = 0 THEN NULL ELSE round(sum(value) / count(*), 9) END AS mean,
 round(sum(value * 2) / sum(value), 6) AS ratio FROM events GROUP BY event_type HAVING max(value) - min(value) > 10""")
def agg_arith(spark, d):  # noqa: ANN001, ANN201
    v = c("value")
    out = events(spark, d).groupBy("event_type").agg(F.round(A.max_(v) - A.min_(v), 6).alias("spread"), F.round(A.divide(A.sum_(v), A.count()), 9).alias("mean"), F.round(A.divide(A.sum_(v * 2), A.sum_(v)), 6).alias("ratio"))
    return basic.having(out, c("spread") > 10)


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ROLLUP (user_id, event_type)")
def agg_rollup(spark, d):  # noqa: ANN001, ANN201
    return events(spark, d).rollup("user_id", "event_type").agg(A.count().alias("n"), F.round(A.sum_(c("value")), 6).alias("total"))


@query("SELECT event_type, round(sum(value) FILTER (WHERE value > 100), 6) AS big, median(value) AS middle FROM events GROUP BY event_type")
def agg_filter_median(spark, d):  # noqa: ANN001, ANN201
    return events(spark, d).groupBy("event_type").agg(F.round(F.sum(F.when(c("value") > 100, c("value"))), 6).alias("big"), F.median("value").alias("middle"))


# ---- windows

@query("""SELECT user_id, w_id, count(*) AS n, round(sum(value), 6) AS total FROM (
 SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS w_id, count(*) OVER (PARTITION BY user_id) AS c FROM events)
 WHERE w_id < c // 10 GROUP BY user_id, w_id""")
def count_window(spark, d):  # noqa: ANN001, ANN201
    return windows.count_window(events(spark, d), 10, keys=["user_id"]).groupBy("user_id", "w_id").agg(A.count().alias("n"), F.round(A.sum_(c("value")), 6).alias("total"))


@query("""SELECT event_id, user_id, round(total, 6) AS total FROM (SELECT event_id, user_id, row_number() OVER w AS rn,
 sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS total
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn >= 5 AND (rn - 5) % 3 = 0""")
def sliding_count(spark, d):  # noqa: ANN001, ANN201
    out = windows.sliding_count(events(spark, d), 5, 3, {"total": A.total(c("value"))}, keys=["user_id"])
    return out.select("event_id", "user_id", F.round("total", 6).alias("total"))


@query("""WITH b AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 12 HOUR, false) AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, CAST(sum(brk::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS w_id FROM b),
 l AS (SELECT *, max(w_id) OVER (PARTITION BY user_id) AS last FROM s)
 SELECT user_id, w_id, count(*) AS n, min(ts) AS opened, max(ts) AS closed FROM l WHERE w_id < last GROUP BY user_id, w_id""")
def session(spark, d):  # noqa: ANN001, ANN201
    return windows.session_window(events(spark, d), 12 * HOUR, keys=["user_id"]).groupBy("user_id", "w_id").agg(A.count().alias("n"), F.min("ts").alias("opened"), F.max("ts").alias("closed"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS w_start, event_type, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY 1, 2")
def tumbling_aligned(spark, d):  # noqa: ANN001, ANN201
    return windows.tumbling_aligned(events(spark, d), "1 day").groupBy("w_start", "event_type").agg(A.count().alias("n"), F.round(A.avg(c("value")), 9).alias("mean"))


@query("""SELECT w_start, count(*) AS n, round(sum(value), 6) AS total FROM (
 SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w_start FROM events) GROUP BY w_start""")
def sliding_aligned(spark, d):  # noqa: ANN001, ANN201
    return windows.sliding_aligned(events(spark, d), "1 day", "12 hours").groupBy("w_start").agg(A.count().alias("n"), F.round(A.sum_(c("value")), 6).alias("total"))


@query("SELECT event_id, user_id, round(value - lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def rstream_delta(spark, d):  # noqa: ANN001, ANN201
    e = events(spark, d)
    return e.select("event_id", "user_id", F.round(c("value") - windows.delayed(e, 2, "value", keys=["user_id"]), 6).alias("delta"))


_ANCHORED = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 t AS (SELECT user_id, rn, ts, value, ts AS w_start FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.rn, e.ts, e.value, CASE WHEN e.ts >= t.w_start + INTERVAL 1 DAY THEN e.ts ELSE t.w_start END FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)"""


@query(_ANCHORED + """, l AS (SELECT *, max(w_start) OVER (PARTITION BY user_id) AS last FROM t)
 SELECT user_id, w_start, count(*) AS n, round(sum(value), 6) AS total FROM l WHERE w_start < last GROUP BY user_id, w_start""")
def tumbling_anchored(spark, d):  # noqa: ANN001, ANN201
    return windows.tumbling_anchored(events(spark, d), DAY, keys=["user_id"]).groupBy("user_id", "w_start").agg(A.count().alias("n"), F.round(A.sum_(c("value")), 6).alias("total"))


@query(_ANCHORED + """, m AS (SELECT DISTINCT user_id, w_start FROM t)
 SELECT m.user_id, m.w_start AS ts, count(*) AS n, round(sum(e.value), 6) AS total FROM m JOIN events e ON e.user_id = m.user_id AND e.ts BETWEEN m.w_start - INTERVAL 2 DAY AND m.w_start GROUP BY 1, 2""")
def sliding_anchored(spark, d):  # noqa: ANN001, ANN201
    out = windows.sliding_anchored(events(spark, d), 2 * DAY, DAY, {"n": A.count(), "total": A.total(c("value"))}, keys=["user_id"])
    return out.select("user_id", "ts", "n", F.round("total", 6).alias("total"))


@query("""SELECT w_id, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS w_id, count(*) OVER () AS c FROM events)
 WHERE w_id < c // 100 GROUP BY w_id""")
def count_window_global(spark, d):  # noqa: ANN001, ANN201
    return windows.count_window(events(spark, d), 100).groupBy("w_id").agg(A.count().alias("n"), F.round(A.sum_(c("value")), 6).alias("total"))


# ---- joins

@query("""WITH u AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN struct_pack(ts := ts, v := value) END AS a, CASE WHEN event_type = 'click' THEN struct_pack(ts := ts, v := value) END AS b
 FROM events WHERE event_type IN ('view', 'click')),
 l AS (SELECT user_id, ts, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
 SELECT CAST(user_id AS VARCHAR) AS key, ts, a.v AS view_value, b.v AS click_value FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND a.ts >= ts - INTERVAL 6 HOUR AND b.ts >= ts - INTERVAL 6 HOUR""")
def latest_join(spark, d):  # noqa: ANN001, ANN201
    e = events(spark, d)
    out = joins.latest_join({"v": (e.where("event_type = 'view'"), "user_id"), "k": (e.where("event_type = 'click'"), "user_id")}, window_micros=6 * HOUR)
    return out.select("key", "ts", c("v.value").alias("view_value"), c("k.value").alias("click_value"))


@query("""SELECT l.event_id AS l_id, r.event_id AS r_id FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'purchase'
 AND (r.ts, r.event_id) > (l.ts, l.event_id) AND r.ts <= l.ts + INTERVAL 1 DAY""")
def interval_join(spark, d):  # noqa: ANN001, ANN201
    e = events(spark, d)
    out = joins.interval_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), key="user_id", within_micros=DAY)
    return out.select(c("l.event_id").alias("l_id"), c("r.event_id").alias("r_id"))


@query("""SELECT l.event_id FROM events l WHERE l.event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = l.user_id AND r.event_type = 'purchase'
 AND (r.ts, r.event_id) > (l.ts, l.event_id) AND r.ts <= l.ts + INTERVAL 1 DAY)""")
def absence(spark, d):  # noqa: ANN001, ANN201
    e = events(spark, d)
    return joins.absence(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), key="user_id", within_micros=DAY).select("event_id")


@query("""SELECT event_id FROM events WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')
 INTERSECT SELECT event_id FROM events WHERE value > 20""")
def set_operations(spark, d):  # noqa: ANN001, ANN201
    e = events(spark, d)
    buyers = e.where("event_type = 'purchase'").select(c("user_id").alias("u")).distinct()
    return e.where("event_type = 'view'").join(buyers, c("user_id") == c("u"), "left_semi").select("event_id").intersect(e.where("value > 20").select("event_id"))


@query("SELECT o_orderkey, CAST(count(l_linenumber) AS BIGINT) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey")
def order_shipments(spark, d):  # noqa: ANN001, ANN201
    o, x = table(spark, d, "orders"), table(spark, d, "lineitem")
    joined = o.join(x, (c("o_orderkey") == c("l_orderkey")) & (c("l_shipdate") <= c("o_orderdate") + F.expr("INTERVAL 30 DAYS")), "left")
    return joined.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n"))


# ---- patterns

_NEXT = "SELECT * FROM events n WHERE n.user_id = {p}.user_id AND n.event_type = '{t}' AND (n.ts, n.event_id) > ({p}.ts, {p}.event_id) ORDER BY n.ts, n.event_id LIMIT 1"


def _next(p: str, t: str) -> str:
    return _NEXT.format(p=p, t=t)


def _run(spark, d, steps, **kw):  # noqa: ANN001, ANN202
    return patterns.sequence(events(spark, d), steps, key="user_id", **kw)


@query(f"SELECT a.event_id AS a_id, b.event_id AS b_id, b.value AS b_value FROM events a, LATERAL ({_next('a', 'purchase')}) b WHERE a.event_type = 'view' AND b.ts <= a.ts + INTERVAL 1 DAY")
def seq2(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, [Step("a", of_type("view")), Step("b", of_type("purchase"))], within_micros=DAY)
    return out.select(c("a.event_id").alias("a_id"), c("b.event_id").alias("b_id"), c("b.value").alias("b_value"))


@query(f"SELECT a.event_id AS a_id, b.event_id AS b_id, k.event_id AS c_id FROM events a, LATERAL ({_next('a', 'click')}) b, LATERAL ({_next('b', 'purchase')}) k WHERE a.event_type = 'view' AND k.ts <= a.ts + INTERVAL 2 DAY")
def seq3(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, [Step("a", of_type("view")), Step("b", of_type("click")), Step("c", of_type("purchase"))], within_micros=2 * DAY)
    return out.select(c("a.event_id").alias("a_id"), c("b.event_id").alias("b_id"), c("c.event_id").alias("c_id"))


@query(ORACLES["seq3"])
def seq_hot_keys(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, [Step("a", of_type("view")), Step("b", of_type("click")), Step("c", of_type("purchase"))], within_micros=2 * DAY, split=2)
    return out.select(c("a.event_id").alias("a_id"), c("b.event_id").alias("b_id"), c("c.event_id").alias("c_id"))


@query(f"""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a, LATERAL ({_next('a', 'purchase')}) b WHERE a.event_type = 'view' AND b.ts <= a.ts + INTERVAL 1 DAY
 AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = a.user_id AND x.event_type = 'error' AND (x.ts, x.event_id) > (a.ts, a.event_id) AND (x.ts, x.event_id) <= (b.ts, b.event_id))""")
def seq_not(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, [Step("a", of_type("view")), Step("b", of_type("purchase"))], within_micros=DAY, unless=of_type("error"))
    return out.select(c("a.event_id").alias("a_id"), c("b.event_id").alias("b_id"))


@query("""SELECT event_id AS a_id, nid AS b_id FROM (SELECT *, lead(event_id) OVER w AS nid, lead(event_type) OVER w AS nt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 WHERE event_type = 'view' AND nt = 'click'""")
def seq_strict(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, [Step("a", of_type("view")), Step("b", of_type("click"))], strict=True)
    return out.select(c("a.event_id").alias("a_id"), c("b.event_id").alias("b_id"))


@query(f"""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a, LATERAL (SELECT * FROM events n WHERE n.user_id = a.user_id AND n.event_type = 'purchase' AND n.value > a.value
 AND (n.ts, n.event_id) > (a.ts, a.event_id) AND n.ts <= a.ts + INTERVAL 1 DAY ORDER BY n.ts, n.event_id LIMIT 1) b WHERE a.event_type = 'view'""")
def seq_condition(spark, d):  # noqa: ANN001, ANN201
    e = events(spark, d)
    out = patterns.sequence_by_condition(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), c("r.value") > c("l.value"), key="user_id", within_micros=DAY)
    return out.select(c("l.event_id").alias("a_id"), c("r.event_id").alias("b_id"))


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id, k.event_id AS c_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts <= a.ts + INTERVAL 1 DAY
 JOIN events k ON k.user_id = a.user_id AND k.event_type = 'purchase' AND (k.ts, k.event_id) > (b.ts, b.event_id) AND k.ts <= a.ts + INTERVAL 1 DAY""")
def seq_every_match(spark, d):  # noqa: ANN001, ANN201
    out = patterns.every_match(events(spark, d), [Step("a", of_type("view")), Step("b", of_type("click")), Step("c", of_type("purchase"))], key="user_id", within_micros=DAY)
    return out.select(c("a.event_id").alias("a_id"), c("b.event_id").alias("b_id"), c("c.event_id").alias("c_id"))


@query(f"""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a, LATERAL ({_next('a', 'click')}) b WHERE a.event_type = 'signup' AND b.ts <= a.ts + INTERVAL 1 DAY
 UNION ALL SELECT a.event_id, b.event_id FROM events a, LATERAL ({_next('a', 'signup')}) b WHERE a.event_type = 'click' AND b.ts <= a.ts + INTERVAL 1 DAY""")
def and_pair(spark, d):  # noqa: ANN001, ANN201
    out = patterns.both(events(spark, d), of_type("signup"), of_type("click"), key="user_id", within_micros=DAY)
    return out.select(c("first.event_id").alias("a_id"), c("second.event_id").alias("b_id"))


@query("""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a, LATERAL (SELECT * FROM events n WHERE n.user_id = a.user_id AND n.event_type IN ('purchase', 'signup')
 AND (n.ts, n.event_id) > (a.ts, a.event_id) ORDER BY n.ts, n.event_id LIMIT 1) b WHERE a.event_type = 'error' AND b.ts <= a.ts + INTERVAL 1 DAY""")
def or_pair(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, [Step("a", of_type("error")), Step("b", patterns.either(of_type("purchase"), of_type("signup")))], within_micros=DAY)
    return out.select(c("a.event_id").alias("a_id"), c("b.event_id").alias("b_id"))


@query("""SELECT l.event_id AS a_id, r.event_id AS b_id FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'signup' AND r.event_type = 'view'
 AND (r.ts, r.event_id) > (l.ts, l.event_id) AND r.ts <= l.ts + INTERVAL 1 DAY""")
def kleene_tail(spark, d):  # noqa: ANN001, ANN201
    e = events(spark, d)
    out = patterns.kleene_tail(e.where("event_type = 'signup'"), e.where("event_type = 'view'"), key="user_id", within_micros=DAY)
    return out.select(c("l.event_id").alias("a_id"), c("r.event_id").alias("b_id"))


@query(f"""SELECT a.event_id AS a_id, k.event_id AS c_id, m.last_id AS b_id, m.n AS b_count FROM events a, LATERAL ({_next('a', 'view')}) b, LATERAL ({_next('b', 'purchase')}) k,
 LATERAL (SELECT arg_max(x.event_id, (x.ts, x.event_id)) AS last_id, count(*) AS n FROM events x WHERE x.user_id = a.user_id AND x.event_type = 'view' AND (x.ts, x.event_id) >= (b.ts, b.event_id) AND (x.ts, x.event_id) < (k.ts, k.event_id)) m
 WHERE a.event_type = 'signup' AND k.ts <= a.ts + INTERVAL 3 DAY""")
def kleene_mid(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, [Step("a", of_type("signup")), Step("b", of_type("view"), kleene=True), Step("c", of_type("purchase"))], within_micros=3 * DAY)
    return out.select(c("a.event_id").alias("a_id"), c("c.event_id").alias("c_id"), c("b.event_id").alias("b_id"), "b_count")


@query(f"""SELECT a.event_id AS a_id, k.event_id AS c_id, (SELECT arg_min(x.event_id, (x.ts, x.event_id)) FROM events x WHERE x.user_id = a.user_id AND x.event_type = 'error' AND (x.ts, x.event_id) > (a.ts, a.event_id) AND (x.ts, x.event_id) < (k.ts, k.event_id)) AS b_id
 FROM events a, LATERAL ({_next('a', 'purchase')}) k WHERE a.event_type = 'view' AND k.ts <= a.ts + INTERVAL 1 DAY""")
def optional_step(spark, d):  # noqa: ANN001, ANN201
    out = _run(spark, d, [Step("a", of_type("view")), Step("b", of_type("error"), optional=True), Step("c", of_type("purchase"))], within_micros=DAY)
    return out.select(c("a.event_id").alias("a_id"), c("c.event_id").alias("c_id"), c("b.event_id").alias("b_id"))


@query("""WITH b AS (SELECT *, CASE WHEN value > lag(value) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)
 SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id, count(*) AS n FROM s GROUP BY user_id, run""")
def rising_runs(spark, d):  # noqa: ANN001, ANN201
    return patterns.ever_rising(events(spark, d), "value", key="user_id")


# ---- trends

_TREND = """WITH e AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS w_start FROM events WHERE event_type IN ('signup', 'view')),
 r AS (SELECT b.user_id, b.w_start, b.value,
   count(*) FILTER (x.event_type = 'signup') AS starts, b.event_id, b.ts FROM e b LEFT JOIN e x ON x.user_id = b.user_id AND x.w_start = b.w_start AND (x.ts, x.event_id) < (b.ts, b.event_id) WHERE b.event_type = 'view' GROUP BY ALL),
 g AS (SELECT *, row_number() OVER (PARTITION BY user_id, w_start ORDER BY ts, event_id) AS rn FROM r)"""


def _trends(spark, d):  # noqa: ANN001, ANN202
    e = windows.tumbling_aligned(events(spark, d), "7 days")
    return trends.trends(e, c("event_type") == "signup", c("event_type") == "view", c("value"), by=["user_id", "w_start"])


@query(""", """.join([_TREND.replace("WITH e", "WITH RECURSIVE e"), """t AS (SELECT user_id, w_start, rn, starts::HUGEINT AS n, starts::HUGEINT AS total FROM g WHERE rn = 1
 UNION ALL SELECT g.user_id, g.w_start, g.rn, g.starts + t.total, t.total + g.starts + t.total FROM t JOIN g ON g.user_id = t.user_id AND g.w_start = t.w_start AND g.rn = t.rn + 1)
 SELECT user_id, w_start, CAST(max(total) AS VARCHAR) AS n_trends FROM t GROUP BY user_id, w_start HAVING max(total) > 0"""]))
def trend_count(spark, d):  # noqa: ANN001, ANN201
    return _trends(spark, d).where("n_trends > 0").select("user_id", "w_start", c("n_trends").cast("string").alias("n_trends"))


@query(""", """.join([_TREND.replace("WITH e", "WITH RECURSIVE e"), """t AS (SELECT user_id, w_start, rn, starts::DOUBLE AS total, starts::DOUBLE AS ev, starts * value AS sv FROM g WHERE rn = 1
 UNION ALL SELECT g.user_id, g.w_start, g.rn, t.total + g.starts + t.total, t.ev + t.ev + g.starts + t.total, t.sv + t.sv + (g.starts + t.total) * g.value FROM t JOIN g ON g.user_id = t.user_id AND g.w_start = t.w_start AND g.rn = t.rn + 1)
 SELECT user_id, w_start, CAST(max(ev) AS BIGINT) AS n_events, round(max(sv), 3) AS sum_values FROM t GROUP BY user_id, w_start HAVING max(total) > 0"""]))
def trend_sum(spark, d):  # noqa: ANN001, ANN201
    return _trends(spark, d).where("n_trends > 0").select("user_id", "w_start", c("n_events").cast("long").alias("n_events"), F.round("sum_values", 3).alias("sum_values"))


_MANY = """WITH RECURSIVE e AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS w_start, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') ORDER BY ts, event_id) AS rn FROM events),
 t AS (SELECT user_id, w_start, rn, (event_type = 'signup')::HUGEINT AS s1, 0::HUGEINT AS e1, (event_type = 'click')::HUGEINT AS s2, 0::HUGEINT AS e2 FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.w_start, e.rn, s1 + (event_type = 'signup')::HUGEINT, CASE WHEN event_type = 'view' THEN 2 * e1 + s1 ELSE e1 END, s2 + (event_type = 'click')::HUGEINT, CASE WHEN event_type = 'purchase' THEN 2 * e2 + s2 ELSE e2 END
 FROM t JOIN e ON e.user_id = t.user_id AND e.w_start = t.w_start AND e.rn = t.rn + 1)
 SELECT user_id, w_start, CAST(max(e1) AS VARCHAR) AS n_viewed, CAST(max(e2) AS VARCHAR) AS n_bought FROM t GROUP BY user_id, w_start"""


@query(_MANY)
def trend_many(spark, d):  # noqa: ANN001, ANN201
    e = windows.tumbling_aligned(events(spark, d), "7 days")
    kind = lambda t: c("event_type") == t
    out = trends.many_trends(e, {"viewed": (kind("signup"), kind("view")), "bought": (kind("click"), kind("purchase"))}, by=["user_id", "w_start"])
    return out.select("user_id", "w_start", c("n_viewed").cast("string").alias("n_viewed"), c("n_bought").cast("string").alias("n_bought"))


def _linear():  # noqa: ANN202
    return lambda x: x @ [[0.5], [2.0]] + 1


@query("SELECT event_id, round(value * 0.5 + user_id * 2 + 1, 6) AS risk FROM events")
def score_linear(spark, d):  # noqa: ANN001, ANN201
    return scoring.score(events(spark, d), _linear, inputs=["value", "user_id"], outputs=["risk"]).select("event_id", F.round("risk", 6).alias("risk"))


# ---- functions

@query("""SELECT event_id, abs(-value) AS f_abs, CAST(floor(value) AS BIGINT) AS f_floor, CAST(ceil(value) AS BIGINT) AS f_ceil, CAST(round(value) AS BIGINT) AS f_round, round(sqrt(value), 9) AS f_sqrt,
 round(ln(value), 9) AS f_log, round(log10(value), 9) AS f_log10, round(sin(value), 9) AS f_sin, greatest(10.0, least(100.0, value)) AS f_clamp, user_id % 7 AS f_mod, user_id // 7 AS f_div, least(value, 50.0) AS f_min, greatest(value, 50.0) AS f_max FROM events""")
def fn_math(spark, d):  # noqa: ANN001, ANN201
    t, v = {k: f for k, (_, _, f) in S.TABLE.items()}, c("value")
    nine = lambda x: F.round(x * 1e9) / 1e9  # noqa: E731 - as the SQL rounds; F.round(x, 9) takes other ties
    log = lambda n: F.when(v < 0, F.lit(float("nan"))).otherwise(nine(t[n](v)))  # noqa: E731 - below zero NaN in SQL, null in the table
    known = F.nvl(v, F.lit(50.0))  # the SQL's least and greatest pass over null
    return events(spark, d).select(
        "event_id", t["abs"](-v).alias("f_abs"), t["floor"](v).alias("f_floor"), t["ceil"](v).alias("f_ceil"), t["round"](v).alias("f_round"), nine(t["sqrt"](v)).alias("f_sqrt"),
        log("log").alias("f_log"), log("log10").alias("f_log10"), nine(t["sin"](v)).alias("f_sin"), t["clamp"](v, 10.0, 100.0).alias("f_clamp"),
        (c("user_id") % 7).alias("f_mod"), S.int_div(c("user_id"), F.lit(7)).alias("f_div"), t["min"](known, F.lit(50.0)).alias("f_min"), t["max"](known, F.lit(50.0)).alias("f_max"),
    )


@query("""SELECT c_custkey, upper(c_name) AS f_upper, lower(c_mktsegment) AS f_lower, strlen(c_name) AS f_len, substr(c_name, 2, 3) AS f_sub, replace(c_name, '0', '') AS f_replace, starts_with(c_name, 'Customer') AS f_starts,
 ends_with(c_name, '1') AS f_ends, contains(c_name, '00') AS f_contains, reverse(c_name) AS f_reverse, string_split(c_name, '#')[1] AS f_split, c_name || '/' || c_mktsegment AS f_concat, trim(' ' || c_name || ' ') AS f_trim FROM customer""")
def fn_string(spark, d):  # noqa: ANN001, ANN201
    t, n, m = {k: f for k, (_, _, f) in S.TABLE.items()}, c("c_name"), c("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", t["upper"](n).alias("f_upper"), t["lower"](m).alias("f_lower"), t["len"](n).alias("f_len"), t["substring"](n, F.lit(1), F.lit(4)).alias("f_sub"), t["replace"](n, "0", "").alias("f_replace"),
        t["starts_with"](n, F.lit("Customer")).alias("f_starts"), t["ends_with"](n, F.lit("1")).alias("f_ends"), t["contains"](n, F.lit("00")).alias("f_contains"), t["reverse"](n).alias("f_reverse"),
        t["first"](t["split"](n, F.lit("#"))).alias("f_split"), t["concat"](n, F.lit("/"), m).alias("f_concat"), t["trim"](F.concat(F.lit(" "), n, F.lit(" "))).alias("f_trim"),
    )


@query("""SELECT user_id, len(a) AS n, a[1] AS f_first, a[-1] AS f_last, round(list_sum(a), 6) AS f_sum, round(list_avg(a), 6) AS f_avg, list_sort(a)[1] AS f_low, len(list_distinct(list_transform(a, lambda x: floor(x / 100)))) AS f_bands,
 len(list_filter(a, lambda x: x > 100)) AS f_big, round(var_pop, 4) AS f_variance FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS a, var_pop(value) AS var_pop FROM events GROUP BY user_id)""")
def fn_array(spark, d):  # noqa: ANN001, ANN201
    t, a = {k: f for k, (_, _, f) in S.TABLE.items()}, c("a")
    rows = events(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"]).alias("a"))
    return rows.select(
        "user_id", t["size"](a).alias("n"), t["first"](a).alias("f_first"), t["last"](a).alias("f_last"), F.round(t["sum"](a), 6).alias("f_sum"), F.round(t["avg"](a), 6).alias("f_avg"), t["get"](t["sort"](a), F.lit(0)).alias("f_low"),
        t["size"](t["unique"](F.transform(a, lambda x: F.floor(x / 100)))).alias("f_bands"), t["size"](F.filter(a, lambda x: x > 100)).alias("f_big"), F.round(t["variance"](a), 4).alias("f_variance"),
    )


@query("""SELECT context, symbol, n FROM (SELECT event_type AS symbol, '' AS context, count(*) AS n FROM events GROUP BY 1
 UNION ALL SELECT event_type, p, count(*) FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL GROUP BY 1, 2)""")
def suffix_counts(spark, d):  # noqa: ANN001, ANN201
    return forecast.suffix_counts(events(spark, d), key="user_id", depth=1).select(F.array_join("context", ",").alias("context"), "symbol", "n")


def forecast_sql(types: str) -> str:
    """Chance that a purchase follows a view within two events, contexts of one event, learned from the first half of the time."""
    return f"""WITH e AS (SELECT * FROM events WHERE {types}), cut AS (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 AS u FROM e),
past AS (SELECT *, lag(event_type) OVER w AS before, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, lead(event_type) OVER w AS n1, lead(event_type, 2) OVER w AS n2
 FROM e, cut WHERE epoch_us(ts) <= u WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT count(DISTINCT event_type) AS k, avg(gap) / 1e6 AS gap FROM past),
c AS (SELECT a.event_type AS before, b.event_type AS symbol, (SELECT count(*) FROM past WHERE past.before = a.event_type AND past.event_type = b.event_type) AS n FROM (SELECT DISTINCT event_type FROM past) a, (SELECT DISTINCT event_type FROM past) b),
q AS (SELECT before, symbol, (n + 0.01) / (sum(n) OVER (PARTITION BY before) + 0.01 * k) AS q FROM c, k),
p AS (SELECT (SELECT q FROM q WHERE before = 'view' AND symbol = 'purchase') + (SELECT sum(a.q * b.q) FROM q a JOIN q b ON a.symbol = b.before WHERE a.before = 'view' AND a.symbol <> 'purchase' AND b.symbol = 'purchase') AS p),
t AS (SELECT gap / (SELECT q FROM q WHERE before = 'view' AND symbol = 'purchase') AS t FROM k),
h AS (SELECT quantile_disc(abs(CASE WHEN n1 = 'purchase' OR n2 = 'purchase' THEN 1 ELSE 0 END - p), 0.9) AS h FROM past, p WHERE event_type = 'view')
SELECT event_id, round(p, 6) AS forecast_probability, CAST(1 AS INT) AS forecast_context_depth, 'view' AS forecast_state, round(t, 3) AS forecast_time, round(greatest(0, p - h), 6) AS forecast_lower, round(least(1, p + h), 6) AS forecast_upper
FROM e, cut, p, t, h WHERE event_type = 'view' AND epoch_us(ts) > u AND p >= 0.1"""


def rounded_forecast(df: DataFrame) -> DataFrame:
    return df.select("event_id", *[F.round(n, 6).alias(n) if n != "forecast_time" else F.round(n, 3).alias(n) for n in ("forecast_probability", "forecast_time", "forecast_lower", "forecast_upper")], "forecast_context_depth", "forecast_state")


@query(forecast_sql("true"))
def forecast_rows(spark, d):  # noqa: ANN001, ANN201
    return rounded_forecast(forecast.forecast(events(spark, d), ["view", "purchase"], key="user_id", confidence=0.1, depth=1, horizon=2))


@query()
def forecast_deep(spark, d):  # noqa: ANN001, ANN201
    return forecast.forecast(events(spark, d), ["view", "click", "purchase"], key="user_id", confidence=0.3).select("event_id", F.round("forecast_probability", 9).alias("forecast_probability"), "forecast_context_depth", "forecast_state")
