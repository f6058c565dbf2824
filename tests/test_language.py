"""The pipeline language: parsing, planning, errors, expressions."""

import pytest
from pyspark.sql import functions as F

from sluiceway.plans.lower import Program, Scope
from sluiceway.plans.syntax import Parser, ProgramError, expand, parse


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(7, 2, 2.5, "héllo", [1, 2, 3], {"a": 1}, None)], "i long, j long, x double, s string, a array<long>, m map<string,long>, n long")


@pytest.mark.parametrize(("text", "value"), [
    ("i / j", 3), ("-i / j", -3), ("i / 0", None), ("i % 4", 3), ("-i % 4", -3), ("i ** 2", 49), ("x * 2", 5.0), ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9),
    ("s + \"!\"", "héllo!"), ("len(s)", 6), ("s[0]", "h"), ("s[-1]", "o"), ("s[1:3]", "él"), ("a[0]", 1), ("a[-1]", 3), ("a[9]", None), ("a[1:]", [2, 3]), ("len(a)", 3),
    ("2 in a", True), ("5 not in a", True), ("\"a\" in m", True), ("\"ell\" in \"hello\"", True), ("i in 1..7", False), ("i in 1..=7", True), ("n ?? 5", 5), ("n is null", True), ("m[\"a\"]", 1),
    ("if i > 5 then \"big\" else \"small\"", "big"), ("not (i > 5)", False), ("i > 5 or n > 1", None), ("i > 5 and j < 5", True), ("true xor true", False), ("6 & 3", 2), ("6 | 1", 7), ("6 ^ 3", 5), ("1 << 4", 16), ("~0", -1),
    ("a.filter(v => v > 1).sum()", 5.0), ("a.map(v => v * 2)", [2, 4, 6]), ("range(3)", [0, 1, 2]), ("push(a, 4)", [1, 2, 3, 4]), ("pop(a)", [1, 2]), ("set(a, 1, 9)", [1, 9, 3]), ("round(2.5)", 3), ("round(-2.5)", -3),
    ("clamp(i, 0, 5)", 5), ("substring(s, 1, 3)", "él"), ("substring(s, 3, 99)", None), ("to_int(\"12\")", 12), ("to_int(\"x\")", None), ("split(\"a.b\", \".\")", ["a", "b"]), ("type_of(x)", "float"), ("min(i, j)", 2), ("is_null(n)", True),
])
def test_expressions(row, text, value):
    got = row.select(Scope(row).column(Parser(text).expr()).alias("v")).first().v
    assert got == value


def test_loops_are_written_out():
    assert [s.name for s in parse(expand("for i in 0..3:\n    stream S{i} = T.where(k == {i})\n"))] == ["S0", "S1", "S2"]


@pytest.mark.parametrize("text", ["stream = A", "stream S = A.where(", "stream S A", "let x", "stream S = A.where(1 +)", "%"])
def test_bad_syntax_says_where(text):
    with pytest.raises(ProgramError, match="line 1"):
        parse(text)


@pytest.mark.parametrize(("text", "what"), [
    ("stream S = A.where(nothing > 1)", "unknown name"), ("stream S = A.where(foo(x) > 1)", "unknown function"), ("stream S = A.fork(x)", "not supported"), ("stream S = B", "unknown event type"),
    ("stream S = T\nstream T = S", "circle"), ("stream S = A\nstream S = A", "twice"), ("stream S = A.to(Nowhere)", "unknown connector"), ("stream S = A.where(abs(1, 2) > 0)", "arguments"),
])
def test_bad_programs(spark, row, text, what):
    with pytest.raises(ProgramError, match=what):
        Program(text, spark, tables={"A": row.withColumn("x", F.lit(1))}).stream("S")


@pytest.mark.parametrize("setting", ["horizon: 5m", "hawkes: true", 'mode: "accurate"'])
def test_forecast_settings_that_are_not_provided_are_rejected(spark, setting):
    events = spark.createDataFrame([("e1", "u", "a"), ("e2", "u", "b")], "event_id string, user_id string, event_type string").withColumn("ts", F.current_timestamp())
    text = "stream S = a as x -> b where user_id == x.user_id as y .forecast(confidence: 0.3{})"
    with pytest.raises(ProgramError, match=rf"forecast\({setting.split(':')[0]}\) is not supported"):
        Program(text.format(f", {setting}"), spark, events=events).stream("S")
    assert "forecast_probability" in Program(text.format(", max_depth: 2"), spark, events=events).stream("S").columns



def test_declarations(spark, row):
    p = Program('event Base:\n    ts: timestamp\nevent Tick extends Base:\n    price: float\n    tags: [str]\ntype Price = float\nconnector Out = file(path: "/tmp/x")\nstream S = A.to(Out)\n', spark, tables={"A": row})
    p.stream("S")
    assert p.declared["Tick"] == {"ts": "timestamp", "price": "float", "tags": "[str]"} and p.sinks["S"][0].target == "Out"


def test_derived_streams_are_planned_once(spark, row):
    p = Program("stream S = A.where(i > 1)\nstream T = S.select(i)\nstream U = S.select(j)", spark, tables={"A": row})
    assert p.stream("T").columns == ["i"] and p.stream("U").columns == ["j"] and p.stream("S") is p.stream("S")


def test_streams_go_to_their_connectors(spark, row, tmp_path):
    p = Program(f'connector Out = file(path: "{tmp_path}/out")\nstream S = A.select(i, s).to(Out)\n', spark, tables={"A": row})
    p.deliver("S")
    assert spark.read.text(f"{tmp_path}/out").first().value == '{"i":7,"s":"héllo"}'


def machine(text, *args, name="f"):
    from sluiceway.plans.interpreter import Machine
    from sluiceway.plans.syntax import parse

    return Machine({n.name: n for n in parse(text) if n.kind == "fn"}).call(name, list(args))


def test_imperative_arithmetic_is_exact():
    assert machine("fn f(a: int, b: int) -> int: a / b", 9007199254740993, 1) == 9007199254740993
    assert machine("fn f(a: int, b: int) -> int: a / b", -7, 2) == -3 and machine("fn f(a: int, b: int) -> int: a % b", -7, 2) == -1
    assert machine("fn f(a: int, b: int) -> int: a % b", 9007199254740993, 2) == 1 and machine("fn f(a: int) -> int: a / 0", 5) is None


def test_imperative_functions_give_no_value_on_wrong_input():
    for call in ("to_int(x)", "upper(3)", "get([1], 5)", "first([])", "sqrt(0 - 1)", "log(0)", "x - 1", "x.name", "[1, 2][7]"):
        assert machine(f"fn f(x: str): {call}", "text") is None, call
    assert machine('fn f(x: str): join(unique(sort(split(x, ","))), "-")', "b,a,b") == "a-b"
    assert machine("fn f(x: float): round(x)", 2.5) == 3 and machine("fn f(x: float): round(x)", -2.5) == -3
    assert machine("fn f(x: str): len(x)", "\u00e9") == 2 and machine("fn f(x: str): type_of([x])", "a") == "array"


def test_log_of_zero_is_minus_infinity_and_below_zero_no_value(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate((0.0, -0.0, -1.0, 1.0, None))], "event_id long, x double")
    made = {f: [r.event_id for r in Program(f"stream S = A.where({f}).select(event_id)", spark, tables={"A": df}).stream("S").orderBy("event_id").collect()] for f in ("log(x) < 1", "log10(x) < 1", "log(x) >= 0")}
    assert made == {"log(x) < 1": [0, 1, 3], "log10(x) < 1": [0, 1, 3], "log(x) >= 0": [3]}


def test_imperative_names_are_checked_at_planning(spark):
    df = spark.createDataFrame([(1, 0, "a")], "event_id long, ts long, event_type string")
    for body, message in (("nothing(x)", "unknown function"), ("x + y", "unknown name")):
        with pytest.raises(ProgramError, match=message):
            Program(f"fn f(x: int): {body}\nstream S = a.process(f(event_id))", spark, events=df).stream("S")


def test_longer_trends_equal_brute_force(spark):
    import itertools
    import random

    from sluiceway.operators import trends

    rnd = random.Random(4)
    rows = [(k, k, rnd.choice("abcd")) for k in range(11)]
    df = spark.createDataFrame(rows, "event_id long, ts long, kind string").withColumn("g", F.lit(1))
    steps = [("a", "a", False), ("b", "b", True), ("c", "c", False), ("d", "d", True)]
    for chain in (steps[:3], steps[1:], steps, [("a", "a", True), ("b", "b", False)], steps[:1]):
        want, events = 0, 0
        for n in range(1, len(rows) + 1):
            for picked in itertools.combinations(rows, n):
                runs = [(k, len(list(g))) for k, g in itertools.groupby(r[2] for r in picked)]
                if [k for k, _ in runs] == [s[1] for s in chain] and all(m == 1 or s[2] for (_, m), s in zip(runs, chain, strict=True)):
                    want, events = want + 1, events + sum(m for (k, m) in runs if k == "b")
        got = trends.chain_trends(df, [(a, F.col("kind") == k, r) for a, k, r in chain], by=["g"], count=["b"] if any(s[0] == "b" for s in chain) else []).first()
        assert got.n_trends == want, chain
        if any(s[0] == "b" for s in chain):
            assert got.n_b == events


def test_forecasts_do_not_look_ahead(spark):
    from sluiceway.operators import forecast

    rows = [(k, 1, "ab"[k % 2], k) for k in range(60)] + [(k, 1, "ac"[k % 2], k) for k in range(60, 100)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    got = forecast.forecast(df, ["a", "b"], key="user_id", depth=1, horizon=1).collect()
    assert [r.event_id for r in got] == list(range(50, 100, 2)) and min(r.forecast_probability for r in got) > 0.99  # "c" came later
    assert all(r.forecast_lower <= r.forecast_probability <= r.forecast_upper and r.forecast_time == pytest.approx(1, abs=0.01) for r in got)
    assert forecast.forecast(df, ["a", "b"], key="user_id", warmup=51).count() == 0 and forecast.forecast(df.limit(0), ["a", "b"], key="user_id").count() == 0
    assert {r.forecast_lower for r in forecast.forecast(df, ["a", "b"], key="user_id", coverage=None).collect()} == {None}
