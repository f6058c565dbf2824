"""Operators against plain Python on small random streams, and their edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import aggregates as A
from sluiceway.operators import basic, joins, patterns, trends, windows
from sluiceway.operators.patterns import Step, of_type

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
MINUTE = 60_000_000


def stream(seed, n=60, users=3, types="ABCD", ties=False):
    rnd, rows, at = random.Random(seed), [], 0
    for i in range(n):
        at += rnd.choice([0, 1, 3, 20] if ties else [1, 2, 5, 20])
        rows.append((i, BASE + dt.timedelta(minutes=at), rnd.randrange(users), rnd.choice(types), float(rnd.randrange(100))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(r[2], []).append(r)
    return out.values()


def greedy(rows, steps, within, bad=None):
    """The engine's rule, one event at a time."""
    out = []
    for events in by_user(rows):
        runs = []
        for e in events:
            for r in list(runs):
                if bad and e[3] == bad:
                    runs.remove(r)
                elif e[3] == steps[len(r)]:
                    r.append(e)
                    if len(r) == len(steps):
                        runs.remove(r)
                        if e[1] - r[0][1] <= within:
                            out.append(tuple(x[0] for x in r))
            if e[3] == steps[0]:
                runs.append([e])
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("steps", "bad"), [("AB", None), ("ABC", None), ("AAB", None), ("AB", "D"), ("ABA", "C")])
def test_sequences(spark, seed, steps, bad):
    rows = stream(seed, ties=seed % 2 == 1)
    made = patterns.sequence(frame(spark, rows), [Step(f"s{k}", of_type(t)) for k, t in enumerate(steps)], key="user_id", within_micros=60 * MINUTE, unless=of_type(bad) if bad else None)
    got = sorted(tuple(r) for r in made.select(*[F.col(f"s{k}.event_id") for k in range(len(steps))]).collect())
    assert got == greedy(rows, steps, dt.timedelta(minutes=60), bad)


@pytest.mark.parametrize("split", [1, 3])
@pytest.mark.parametrize(("steps", "bad"), [("ABC", None), ("AB", "D")])
def test_slices_of_hot_keys_change_nothing(spark, steps, bad, split):
    rows = stream(11, n=120, users=1, ties=True)
    made = patterns.sequence(frame(spark, rows), [Step(f"s{k}", of_type(t)) for k, t in enumerate(steps)], key="user_id", within_micros=45 * MINUTE, unless=of_type(bad) if bad else None, split=split)
    got = sorted(tuple(r) for r in made.select(*[F.col(f"s{k}.event_id") for k in range(len(steps))]).collect())
    assert got and got == greedy(rows, steps, dt.timedelta(minutes=45), bad)


@pytest.mark.parametrize("seed", range(3))
def test_kleene_of_any_number(spark, seed):
    rows = stream(seed)
    steps = [Step("a", of_type("A")), Step("b", of_type("B"), kleene=True, optional=True), Step("c", of_type("C"))]
    got = {r[0]: tuple(r)[1:] for r in patterns.sequence(frame(spark, rows), steps, key="user_id").select("a.event_id", F.col("b.event_id"), F.col("c.event_id"), "b_count").collect()}
    expected = {}
    for events in by_user(rows):
        for k, a in enumerate(events):
            if a[3] == "A":
                held = []
                for e in events[k + 1 :]:
                    if e[3] == "B":
                        held.append(e[0])
                    elif e[3] == "C":
                        expected[a[0]] = (held[-1] if held else None, e[0], len(held))
                        break
    assert got == expected


@pytest.mark.parametrize("seed", range(3))
def test_kleene_between_two_steps(spark, seed):
    rows = stream(seed)
    steps = [Step("a", of_type("A")), Step("b", of_type("B"), kleene=True), Step("c", of_type("C"))]
    got = sorted(tuple(r) for r in patterns.sequence(frame(spark, rows), steps, key="user_id").select("a.event_id", F.col("b.event_id"), F.col("c.event_id"), "b_count").collect())
    expected = []
    for events in by_user(rows):
        for k, a in enumerate(events):
            if a[3] == "A":
                held = []
                for e in events[k + 1 :]:
                    if e[3] == "B":
                        held.append(e[0])
                    elif e[3] == "C" and held:
                        expected.append((a[0], held[-1], e[0], len(held)))
                        break
    assert got == sorted(expected)


@pytest.mark.parametrize("seed", range(3))
def test_trends_equal_listing_them(spark, seed):
    rows = stream(seed, n=24, users=2, types="AB")
    got = {r.user_id: (int(r.n_trends), int(r.n_events), r.sum_values, r.min_value, r.max_value) for r in trends.trends(frame(spark, rows), F.col("event_type") == "A", F.col("event_type") == "B", F.col("value"), by=["user_id"]).collect()}
    for events in by_user(rows):
        found = []
        starts = [k for k, e in enumerate(events) if e[3] == "A"]
        repeats = [k for k, e in enumerate(events) if e[3] == "B"]
        for a in starts:
            later = [k for k in repeats if k > a]
            for mask in range(1, 1 << len(later)):
                found.append([events[later[j]][4] for j in range(len(later)) if mask >> j & 1])
        flat = [v for t in found for v in t]
        assert got[events[0][2]] == (len(found), len(flat), pytest.approx(sum(flat)), min(flat, default=None), max(flat, default=None))


@pytest.mark.parametrize("flush", [False, True])
def test_anchored_windows(spark, flush):
    rows = stream(5, n=80)
    got = {(r.user_id, r.w_start): r.n for r in windows.tumbling_anchored(frame(spark, rows), 30 * MINUTE, keys=["user_id"], flush=flush).groupBy("user_id", "w_start").agg(F.count(F.lit(1)).alias("n")).collect()}
    expected = {}
    for events in by_user(rows):
        start, own = None, {}
        for e in events:
            if start is None or e[1] >= start + dt.timedelta(minutes=30):
                start = e[1]
            own[start] = own.get(start, 0) + 1
        if not flush:
            del own[start]
        expected |= {(events[0][2], s): n for s, n in own.items()}
    assert got == expected


def test_a_scan_spans_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_anchored_windows(spark, True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_sessions_part_above_the_gap_only(spark):
    rows = [(i, BASE + dt.timedelta(minutes=m), 1, "A", 1.0) for i, m in enumerate([0, 10, 20, 31, 41])]
    got = windows.session_window(frame(spark, rows), 10 * MINUTE, keys=["user_id"], flush=True).orderBy("event_id").select("w_id").collect()
    assert [r.w_id for r in got] == [0, 0, 0, 1, 1]


def test_count_windows(spark):
    rows = [(i, BASE + dt.timedelta(minutes=i), 1, "A", float(i)) for i in range(11)]
    assert windows.count_window(frame(spark, rows), 5, keys=["user_id"]).count() == 10
    assert windows.count_window(frame(spark, rows), 5, keys=["user_id"], flush=True).count() == 11
    got = windows.sliding_count(frame(spark, rows), 4, 2, {"s": A.total(F.col("value"))}, keys=["user_id"]).orderBy("event_id").collect()
    assert [(r.event_id, r.s) for r in got] == [(3, 6.0), (5, 14.0), (7, 22.0), (9, 30.0)]


def test_aggregates_skip_missing_numbers(spark):
    rows = [(0, BASE, 1, "A", float("nan")), (1, BASE, 1, "A", None), (2, BASE, 1, "A", 4.0), (3, BASE, 1, "A", 8.0)]
    v = F.col("value")
    r = frame(spark, rows).agg(A.count().alias("n"), A.sum_(v).alias("s"), A.avg(v).alias("a"), A.min_(v).alias("lo"), A.max_(v).alias("hi"), A.ema(v, 3).alias("e"), A.last(v).alias("l"), A.first(F.col("event_id")).alias("f")).first()
    assert tuple(r) == (4, 12.0, 6.0, 4.0, 8.0, 6.0, 8.0, 0)
    r = frame(spark, []).agg(A.sum_(v).alias("s"), A.avg(v).alias("a")).first()
    assert tuple(r) == (0.0, None)


@pytest.mark.parametrize("split", [None, 1, 3])
def test_latest_join_against_replay(spark, split):
    rows = stream(9, types="AB")
    e = frame(spark, rows)
    got = sorted((r.ts, r.a.event_id, r.b.event_id) for r in joins.latest_join({"a": (e.where("event_type = 'A'"), "user_id"), "b": (e.where("event_type = 'B'"), "user_id")}, window_micros=15 * MINUTE, split=split).collect())
    expected = []
    for events in by_user(rows):
        last = {}
        for x in events:
            last[x[3]] = x
            if len(last) == 2 and all(x[1] - y[1] <= dt.timedelta(minutes=15) for y in last.values()):
                expected.append((x[1], last["A"][0], last["B"][0]))
    assert got == sorted(expected)


def test_merge_passes_an_event_once(spark):
    e = frame(spark, stream(1))
    assert basic.merge((e, F.col("value") > 10), (e, F.col("value") > 50)).count() == e.where("value > 10").count()


def test_enrich_without_fallback_drops(spark):
    e = frame(spark, stream(1, users=3))
    ref = spark.createDataFrame([(0, "x"), (1, "y")], "k long, name string")
    assert basic.enrich(e, ref, key=F.col("user_id"), ref_key="k", fields=["name"]).where("user_id = 2").count() == 0
    got = basic.enrich(e, ref, key=F.col("user_id"), ref_key="k", fields=["name"], fallback={"name": "?"}).where("user_id = 2").select("name", "enrich_status").distinct().collect()
    assert [tuple(r) for r in got] == [("?", "error")]


def _broken():
    def model(x):
        raise ValueError("no")

    return model


def test_scores_and_failures(spark):
    from sluiceway.operators.scoring import score

    e = frame(spark, [(0, BASE, 1, "A", 3.0), (1, BASE, 1, "A", None)])
    got = {r.event_id: r.y for r in score(e, lambda: lambda x: x * 2, inputs=["value"], outputs=["y"]).collect()}
    assert got == {0: 6.0, 1: 0.0}
    assert [r.y for r in score(e, _broken, inputs=["value"], outputs=["y"]).collect()] == [None, None]


def test_numbers_follow_the_order(spark):
    rows = stream(3, ties=True)
    got = {r.event_id: r.n for r in windows.numbered(frame(spark, rows), "n").collect()}
    assert [got[r[0]] for r in sorted(rows, key=lambda r: (r[1], r[0]))] == list(range(1, len(rows) + 1))
    assert windows.numbered(frame(spark, []), "n").count() == 0


def test_many_trends_equal_single_ones(spark):
    e = frame(spark, stream(8))
    many = {r.user_id: (r.n_x, r.n_y) for r in trends.many_trends(e, {"x": (F.col("event_type") == "A", F.col("event_type") == "B"), "y": (F.col("event_type") == "C", F.col("event_type") == "D")}, by=["user_id"]).collect()}
    for k, (a, b) in enumerate((("A", "B"), ("C", "D"))):
        one = trends.trends(e, F.col("event_type") == a, F.col("event_type") == b, F.col("value"), by=["user_id"])
        assert {r.user_id: r.n_trends for r in one.collect()} == {u: v[k] for u, v in many.items()}


def test_suffix_tree():
    from sluiceway.operators.forecast import SuffixTree, conformal, hawkes, pruned, waiting_time

    tree = SuffixTree({((), "a"): 50, ((), "b"): 50, (("a",), "b"): 49, (("a",), "a"): 1, (("b",), "a"): 50, (("a", "b"), "a"): 50})
    assert tree.predict(["b", "a"])["b"] == pytest.approx(49.01 / 50.02) and sum(tree.predict(["x"]).values()) == pytest.approx(1)
    assert tree.completion(["b"], ["a"], horizon=1) == pytest.approx(tree.predict(["a"])["b"]) and tree.completion(["b", "a"], ["a"]) > 0.99
    assert ("a", "b") not in pruned(tree).counts and waiting_time(tree, ["b"], ["a"], 2.0) == pytest.approx(2.0 / tree.predict(["a"])["b"])
    assert conformal([0.1] * 9 + [0.9], 0.9) == 0.9 and hawkes([1.0], mu=1.0, alpha=0.5, beta=0.0) == [1.0, 1.5]
