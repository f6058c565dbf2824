"""Syntax trees to DataFrames: expressions become Columns, streams become lazy plans."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import basic, forecast, joins, patterns, scoring, trends, windows
from ..operators.basic import ORDER
from ..operators.patterns import Step
from ..sources.sinks import multi_sink, sink_for
from .interpreter import emitted
from .syntax import Node, ProgramError, parse

WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
COMPARE = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
#: The one key of a sequence whose steps share no field, and the time limits in a slice of its events.
UNKEYED, SLICE = "_all", 16
REJECTED = {"map", "tap", "collect", "on_error", "fork", "any", "all", "concurrent"}


class Scope:
    """Names an expression may use: columns of a frame, constants, functions, lambda variables."""

    def __init__(self, df: DataFrame, constants: Mapping[str, Node] | None = None, functions: Mapping[str, Node] | None = None, bound: Mapping[str, Column] | None = None, prefix: str = ""):
        self.df, self.constants, self.functions, self.bound, self.prefix = df, constants or {}, functions or {}, bound or {}, prefix

    def with_(self, **more: Column) -> Scope:
        return Scope(self.df, self.constants, self.functions, {**self.bound, **more}, self.prefix)

    def name(self, n: str) -> Column:
        if n in self.bound:
            return self.bound[n]
        if n in self.df.columns:
            return F.col(f"`{n}`")
        if n in self.constants:
            return self.column(self.constants[n])
        raise ProgramError(f"unknown name {n!r}; known: {', '.join(self.df.columns)}")

    def kind(self, c: Column) -> T.DataType | None:
        try:
            return self.df.select(c.alias("x")).schema["x"].dataType
        except Exception:  # a lambda's variable has no type outside its lambda
            return None

    def whole(self, *cs: Column) -> bool:
        return all(isinstance(self.kind(c), WHOLE) for c in cs)

    def column(self, x: Node) -> Column:
        made = getattr(self, f"_{x.kind}", None)
        if made is None:
            raise ProgramError(f"{x.kind} is no expression here")
        return made(x)

    def _literal(self, x: Node) -> Column:
        return F.lit(x.value).cast("long") if type(x.value) is int else F.lit(x.value)

    def _duration(self, x: Node) -> Column:
        return F.expr(f"INTERVAL {x.micros} MICROSECONDS")

    def _name(self, x: Node) -> Column:
        return self.name(x.name)

    def _member(self, x: Node) -> Column:
        if x.x.kind == "name":
            flat = f"{x.x.name}.{x.name}"
            if x.x.name not in self.bound and x.x.name not in self.df.columns:
                for n in (flat, f"{x.x.name}_{x.name}", x.name):
                    if n in self.df.columns:
                        return F.col(f"`{n}`")
        return self.column(x.x).getField(x.name)

    def _index(self, x: Node) -> Column:
        a, i = self.column(x.x), self.column(x.i)
        kind = self.kind(a)
        if isinstance(kind, T.MapType):
            return F.try_element_at(a, i)
        if isinstance(kind, T.StringType):
            at = F.when(i >= 0, i).otherwise(F.char_length(a) + i)
            return S.substring(a, at, at + 1)
        return S.element(a, i)

    def _slice(self, x: Node) -> Column:
        a = self.column(x.x)
        text = isinstance(self.kind(a), T.StringType)
        n = F.char_length(a) if text else F.size(a)
        lo, hi = self.column(x.lo) if x.lo else F.lit(0), self.column(x.hi) if x.hi else n
        if text:
            lo, hi = F.least(lo, n), F.least(hi, n)
            return F.when(lo <= hi, S.substring(a, lo, hi)).otherwise("")
        return S.part(a, lo, hi)

    def _array(self, x: Node) -> Column:
        return F.array_compact(F.array(*[self.column(i) for i in x.items]))

    def _map(self, x: Node) -> Column:
        return F.create_map(*[self.column(p) for pair in x.pairs for p in pair])

    def _if(self, x: Node) -> Column:
        return F.when(self.column(x.c), self.column(x.a)).when(~self.column(x.c), self.column(x.b))

    def _not(self, x: Node) -> Column:
        return ~self.column(x.x)

    def _unary(self, x: Node) -> Column:
        c = self.column(x.x)
        return -c if x.op == "-" else F.bitwise_not(c)

    def _binary(self, x: Node) -> Column:
        if x.op == "in" and x.b.kind == "binary" and x.b.op.startswith(".."):
            a, lo, hi = self.column(x.a), self.column(x.b.a), self.column(x.b.b)
            return (a >= lo) & ((a <= hi) if x.b.op == "..=" else (a < hi))
        a, b = self.column(x.a), self.column(x.b)
        if x.op in COMPARE:
            return getattr(a, COMPARE[x.op])(b)
        match x.op:
            case "+":
                return F.concat(a, b) if isinstance(self.kind(a), T.StringType) or isinstance(self.kind(b), T.StringType) else F.try_add(a, b)
            case "-":
                return F.try_subtract(a, b)
            case "*":
                return F.try_multiply(a, b)
            case "/":
                return S.int_div(a, b) if self.whole(a, b) else F.try_divide(a, b)
            case "%":
                return F.try_mod(a, b)
            case "**":
                return S.int_pow(a, b) if self.whole(a, b) else F.pow(a, b)
            case "and":
                return a & b
            case "or":  # a missing side makes the whole missing
                return F.when(a.isNotNull() & b.isNotNull(), a | b)
            case "xor":
                return a != b
            case "??":
                return F.coalesce(a, b)
            case "is":
                return a.eqNullSafe(b)
            case "|":
                return a.bitwiseOR(b)
            case "^":
                return a.bitwiseXOR(b)
            case "&":
                return a.bitwiseAND(b)
            case "<<":
                return F.call_function("shiftleft", a, b.cast("int"))
            case ">>":
                return F.call_function("shiftright", a, b.cast("int"))
            case ".." | "..=":
                return S.number_range(a, b, closed=x.op == "..=")
            case "in" | "not in":
                kind = self.kind(b)
                held = F.map_contains_key(b, a) if isinstance(kind, T.MapType) else F.contains(b, a) if isinstance(kind, T.StringType) else F.array_contains(b, a)
                return held if x.op == "in" else ~held
        raise ProgramError(f"unknown operator {x.op}")

    def _call(self, x: Node) -> Column:
        if x.f.kind == "member":  # array methods
            return self._method(x)
        n, args = x.f.name, x.args
        if n in self.functions:
            return self._user(self.functions[n], [self.column(a) for a in args])
        cols = [self.column(a) for a in args]
        kind = self.kind(cols[0]) if cols else None
        if n == "len" and isinstance(kind, (T.ArrayType, T.MapType)):
            return F.size(cols[0]).cast("long")
        if n == "contains" and isinstance(kind, T.ArrayType):
            return F.array_contains(*cols)
        if n == "contains" and isinstance(kind, T.MapType):
            return F.map_contains_key(*cols)
        if n == "get" and isinstance(kind, T.MapType):
            return F.try_element_at(*cols)
        if n == "set" and isinstance(kind, T.MapType):
            return F.map_concat(F.map_filter(cols[0], lambda k, v: k != cols[1]), F.create_map(cols[1], cols[2]))
        if n == "pow" and self.whole(*cols):
            return S.int_pow(*cols)
        tests = {"is_int": WHOLE, "is_float": (T.DoubleType, T.FloatType), "is_string": (T.StringType,), "is_bool": (T.BooleanType,), "is_array": (T.ArrayType,), "is_map": (T.MapType,)}
        if n in tests:
            return F.lit(isinstance(kind, tests[n])) & cols[0].isNotNull()
        if n == "type_of":
            return F.when(cols[0].isNull(), "null").otherwise(next((k[3:] for k, ts in tests.items() if isinstance(kind, ts)), "timestamp"))
        if n not in S.TABLE:
            raise ProgramError(f"unknown function {n!r}")
        least, most, f = S.TABLE[n]
        if not least <= len(cols) <= most:
            raise ProgramError(f"{n} takes {least} to {most} arguments")
        return f(*cols)

    def _method(self, x: Node) -> Column:
        a, n = self.column(x.f.x), x.f.name
        if n in ("filter", "map"):
            f = x.args[0]
            return (F.filter if n == "filter" else F.transform)(a, lambda v: self.with_(**{f.name: v}).column(f.body))
        made = {"flatten": F.flatten, "len": lambda c: F.size(c).cast("long"), "count": lambda c: F.size(c).cast("long"), "sliding_pairs": S.sliding_pairs, "first": S.TABLE["first"][2], "last": S.TABLE["last"][2], "sum": S.array_sum, "avg": S.array_avg, "min": F.array_min, "max": F.array_max}
        if n not in made:
            raise ProgramError(f"unknown method {n!r}")
        return made[n](a)

    def _user(self, fn: Node, args: list[Column]) -> Column:
        """A function of one expression, written out in place."""
        body = fn.body
        if len(body) != 1 or body[0].kind not in ("return", "value") or len(args) != len(fn.params):
            raise ProgramError(f"{fn.name} is no single expression of {len(fn.params)} parameters; use .process for it")
        return Scope(self.df, self.constants, self.functions, dict(zip(fn.params, args, strict=True))).column(body[0].x)


AGGREGATES: dict[str, Callable[..., Column]] = {"sum": A.sum_, "avg": A.avg, "min": A.min_, "max": A.max_, "stddev": A.stddev, "first": A.first, "last": A.last, "count_distinct": A.count_distinct}


def aggregate(x: Node, scope: Scope, frame: WindowSpec | None = None) -> Column:
    """An aggregate expression: calls of aggregates, joined by arithmetic; of groups, or over a frame."""
    if x.kind == "call" and x.f.kind == "name":
        n, args = x.f.name, list(x.args)
        if n == "count" and args and args[0].kind == "call" and args[0].f.name == "distinct":
            n, args = "count_distinct", args[0].args
        if n == "count":
            return A.count() if frame is None else A.FRAMED[n](frame)
        if n == "ema":
            period = args[1].value if len(args) > 1 else A.EMA_PERIOD
            return A.ema(scope.column(args[0]), period) if frame is None else A.FRAMED[n](frame, scope.column(args[0]), period)
        if n in AGGREGATES:
            return AGGREGATES[n](scope.column(args[0])) if frame is None else A.FRAMED[n](frame, scope.column(args[0]))
    if x.kind == "binary" and x.op in "+-*/":
        a, b = aggregate(x.a, scope, frame), aggregate(x.b, scope, frame)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: A.divide(a, b)}[x.op]()
    if x.kind == "literal":
        return scope.column(x)
    raise ProgramError("an aggregate is expected")


@dataclass
class State:
    """What a stream's operations have gathered."""

    df: DataFrame
    key: str | None = None
    window: Node | None = None
    steps: list[Node] = field(default_factory=list)
    within: int | None = None
    nots: list[Node] = field(default_factory=list)
    on: Node | None = None
    join: list[Node] | None = None
    alias: str | None = None
    matched: bool = False
    by: list[str] = field(default_factory=list)
    sinks: list[Node] = field(default_factory=list)


class Program:
    """A program over tables of events: one frame for each event type, or one with a column event_type.

    Frames hold `ts` and `event_id`, the order of events.
    """

    def __init__(self, text: str, spark: SparkSession, *, events: DataFrame | None = None, tables: Mapping[str, DataFrame] | None = None, models: Mapping[str, scoring.Loader] | None = None, flush: bool = False):
        self.spark, self.events, self.tables, self.models, self.flush = spark, events, dict(tables or {}), dict(models or {}), flush
        self.streams: dict[str, Node] = {}
        self.functions: dict[str, Node] = {}
        self.constants: dict[str, Node] = {}
        self.patterns: dict[str, Node] = {}
        self.declared: dict[str, dict[str, str]] = {}
        self.connectors: dict[str, Node] = {}
        self.made: dict[str, DataFrame] = {}
        self.open: list[str] = []
        self.sinks: dict[str, list[Node]] = {}
        for s in parse(text):
            match s.kind:
                case "stream":
                    if s.name in self.streams:
                        raise ProgramError(f"stream {s.name} is declared twice")
                    self.streams[s.name] = s
                case "fn":
                    self.functions[s.name] = s
                case "let":
                    self.constants[s.name] = s.x
                case "pattern":
                    self.patterns[s.name] = s
                case "event":
                    self.declared[s.name] = {**self.declared.get(s.extends or "", {}), **s.fields}
                case "connector":
                    self.connectors[s.name] = s

    def stream(self, name: str) -> DataFrame:
        """The frame of a stream; streams that it reads are planned once."""
        if name in self.made:
            return self.made[name]
        if name not in self.streams:
            return self.scan(name)
        if name in self.open:
            raise ProgramError(f"streams read each other in a circle: {' -> '.join([*self.open, name])}")
        self.open.append(name)
        try:
            self.made[name] = self._planned(self.streams[name])
        finally:
            self.open.pop()
        return self.made[name]

    def deliver(self, name: str) -> None:
        """Writes a stream to the connectors that its .to(...) operations name, in one evaluation."""
        df = self.stream(name)
        made = []
        for o in self.sinks.get(name, []):
            if o.kind == "shown":
                sink_for("console", {})(o.df)
                continue
            c = self.connectors[o.target]
            made.append(sink_for(c.type, {k: str(v.value) for k, v in {**c.options, **o.options}.items()}))
        multi_sink(made)(df)

    def scan(self, name: str) -> DataFrame:
        if name in self.streams:
            return self.stream(name)
        if name in self.tables:
            return self.tables[name]
        if self.events is not None:
            return self.events.where(F.col("event_type") == name)
        raise ProgramError(f"unknown event type or stream {name!r}")

    def _ticks(self, every: int) -> DataFrame:
        """Ticks over the time of the events: the first is one interval after the first event."""
        if self.events is None:
            raise ProgramError("a timer needs the program's events")
        span = self.events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        step = F.expr(f"INTERVAL {every} MICROSECONDS")
        ticks = F.when(F.col("lo") + step <= F.col("hi"), F.sequence(F.col("lo") + step, F.col("hi"), step))
        return span.select(F.posexplode(ticks).alias("event_id", "ts")).select(F.col("event_id").cast("long"), "ts", F.lit("Timer").alias("event_type"))

    def scope(self, df: DataFrame, **bound: Column) -> Scope:
        return Scope(df, self.constants, self.functions, bound)

    def _planned(self, s: Node) -> DataFrame:
        src, st = s.source, None
        if src.kind == "scan" and src.name in self.patterns:
            p = self.patterns[src.name]
            st = State(self._pattern(p), key=p.key, matched=True)
        elif src.kind == "scan":
            st = State(self.scan(src.name), alias=src.alias)
            if src.alias or any(o.kind == "then" for o in s.ops):
                st.steps = [Node("step", {"type": src.name, "kleene": "+" if src.every else None, "where": None, "alias": src.alias or src.name, "negated": False})]
        elif src.kind == "from":
            st = State(self.scan(src.type))
        elif src.kind == "merge":
            parts: list[tuple[DataFrame, Column | None]] = []
            for b in src.items:
                df = self.scan(b.base)
                parts.append((df, self.scope(df).column(b.cond) if b.cond else None))
            st = State(basic.merge(*parts))
        elif src.kind == "join":
            st = State(self.scan(src.items[0].base), join=src.items, on=functools.reduce(lambda a, b: Node("binary", {"op": "and", "a": a, "b": b}), [b.cond for b in src.items if b.cond], None) if any(b.cond for b in src.items) else None)
        elif src.kind == "timer":
            st = State(self._ticks(src.every))
        elif src.kind == "sequence":
            st = State(self.scan(src.steps[0].type), steps=list(src.steps))
        else:
            raise ProgramError(f"{src.kind} is no source of a batch plan")
        ops = list(s.ops)
        # A chain, its limits and negations are one operator in front of what else is there.
        if st.steps and (len(st.steps) > 1 or any(o.kind == "then" for o in ops)):
            st.steps += [o.step for o in ops if o.kind == "then"]
            for o in ops:
                if o.kind == "within":
                    st.within = o.args[0].micros
                elif o.kind == "not":
                    st.nots.append(o)
                elif o.kind == "partition_by":
                    st.key = o.args[0].name
            ops = [o for o in ops if o.kind not in ("then", "within", "not", "partition_by")]
            if any(o.kind == "trend_aggregate" for o in ops):
                return self._trend(s, st, ops)
            if any(o.kind == "forecast" for o in ops):
                items = next(o for o in ops if o.kind == "forecast").items
                known = {"confidence", "max_depth", "horizon", "warmup", "conformal"}
                if unknown := sorted(n for n, x in items.items() if n not in known or x.kind != "literal"):  # a horizon counts events
                    raise ProgramError(f".forecast({', '.join(unknown)}) is not supported in stream {s.name}")
                given = {n: items[n].value for n in items}
                key = self._key(st)
                df = self._united([x.type for x in st.steps])
                st.df = forecast.forecast(
                    df.withColumn(UNKEYED, F.lit(0)) if key == UNKEYED else df, [x.type for x in st.steps], key=key, confidence=given.get("confidence", 0.5), depth=given.get("max_depth", forecast.DEPTH),
                    horizon=given.get("horizon", forecast.STEPS), warmup=given.get("warmup", 0), coverage=0.9 if given.get("conformal", True) else None,
                )
                ops = [o for o in ops if o.kind != "forecast"]
            else:
                st.df, st.matched = self._chain(st), True
        if st.join:
            for o in ops:
                if o.kind == "on":
                    st.on = o.args[0]
            window = next((o for o in ops if o.kind == "window"), None)
            st.df = self._join(st, window)
            ops = [o for o in ops if o.kind not in ("on", "window")]
        for o in ops:
            self._apply(s, st, o)
        if st.window is not None:
            st.df = self._windowed(st)
        self.sinks[s.name] = st.sinks
        return st.df

    # -- operations

    def _apply(self, s: Node, st: State, o: Node) -> None:
        scope = self.scope(st.df, **({st.alias: F.struct(*[F.col(c) for c in st.df.columns])} if st.alias and not st.matched else {}))
        if o.kind in REJECTED:
            raise ProgramError(f".{o.kind}() is not supported in stream {s.name}")
        match o.kind:
            case "where" | "filter" | "having":
                st.df = basic.where(st.df, scope.column(o.args[0]))
            case "select":
                st.df = st.df.select(*[scope.column(x).alias(n) for n, x in o.items.items()])
            case "emit":
                named = {n: scope.column(x) for n, x in o.items.items()}
                st.df = basic.emit(st.df, as_type=o.as_type, **named) if named else st.df
            case "distinct":
                st.df = basic.distinct_first(st.df.withColumn("_key", scope.column(o.args[0])), "_key").drop("_key") if o.args else basic.distinct_first(st.df)
            case "limit":
                st.df = basic.limit_first(st.df, o.args[0].value, order=[c for c in ORDER if c in st.df.columns] or st.df.columns)
            case "first":
                st.df = basic.limit_first(st.df, 1, order=[c for c in ORDER if c in st.df.columns] or st.df.columns)
            case "order_by":
                st.df = st.df.orderBy(*[F.desc_nulls_last(scope.column(x)) if d else scope.column(x) for x, d in o.items])
            case "partition_by":
                st.key = o.args[0].name
            case "window":
                st.window = o
            case "aggregate":
                self._aggregate(st, o)
            case "lambda_filter":
                rows = F.collect_list(F.struct(*[F.col(c) for c in st.df.columns]))
                tagged, by = self._tagged(st)
                groups = tagged.groupBy(*by).agg(F.array_sort(rows).alias("_events"))
                kept = groups.where(Scope(groups, self.constants, self.functions, {o.x.name: F.col("_events")}).column(o.x.body))
                st.df, st.window = kept.select(F.explode("_events").alias("_e")).select("_e.*"), None
            case "process":
                call = o.args[0]
                st.df = emitted(st.df, self.functions, call.f.name, [scope.column(a) for a in call.args], self.constants)
            case "enrich":
                ref = self.tables.get(o.target)
                if ref is None:
                    raise ProgramError(f"no table for {o.target}")
                fields = [x.name for x in o.options["fields"].items]
                back = {f: o.options["fallback"].value for f in fields} if "fallback" in o.options else None
                st.df = basic.enrich(st.df, ref, key=scope.column(o.options["key"]), ref_key=o.options["key"].name if o.options["key"].kind in ("name", "member") else fields[0], fields=fields, fallback=back)
            case "to":
                if o.target not in self.connectors:
                    raise ProgramError(f"unknown connector {o.target!r}")
                st.sinks.append(o)
            case "score":
                named = o.items["model"]
                model = self.models.get(named.name if named.kind == "name" else named.value)
                if model is None:
                    raise ProgramError(f"no model given for .score(...) in stream {s.name}")
                st.df = scoring.score(st.df, model, inputs=[x.name for x in o.items["inputs"].items], outputs=[x.name for x in o.items["outputs"].items])
            case "print" | "log":
                st.sinks.append(Node("shown", {"df": st.df}))  # by deliver()
            case "watermark" | "allowed_lateness" | "context" | "within":
                pass  # of streaming queries: a batch plan has all its rows at once, and one session
            case _:
                raise ProgramError(f".{o.kind}() is not known")

    def _tagged(self, st: State) -> tuple[DataFrame, list[str]]:
        """Rows with their window, and the columns of a window."""
        keys = [st.key] if st.key else []
        w = st.window
        if w is None:
            return st.df, keys
        if w.session:
            return windows.session_window(st.df, w.size.micros, keys=keys, flush=self.flush), [*keys, "w_id"]
        if w.size.kind == "duration":
            return windows.tumbling_anchored(st.df, w.size.micros, keys=keys, flush=self.flush), [*keys, "w_start"]
        return windows.count_window(st.df, w.size.value, keys=keys, flush=self.flush), [*keys, "w_id"]

    def _windowed(self, st: State) -> DataFrame:
        return self._tagged(st)[0]

    def _aggregate(self, st: State, o: Node) -> None:
        scope, keys = self.scope(st.df), [st.key] if st.key else []
        if st.window is not None and st.window.slide is not None:
            named = {n: functools.partial(aggregate, x, scope) for n, x in o.items.items()}
            if st.window.size.kind == "duration":
                st.df = windows.sliding_anchored(st.df, st.window.size.micros, st.window.slide.micros, named, keys=keys)
            else:
                st.df = windows.sliding_count(st.df, st.window.size.value, st.window.slide.value, named, keys=keys)
            st.df = st.df.select(*ORDER, *keys, *named)
        else:
            tagged, by = self._tagged(st)
            scope = self.scope(tagged)
            last = [F.max(c).alias(c) for c in ORDER if c not in o.items]
            st.df = tagged.groupBy(*by).agg(*last, *[aggregate(x, scope).alias(n) for n, x in o.items.items()])
            if st.key:
                st.df = st.df.withColumn("_partition", windows.partition_label(F.col(st.key)))
        st.window = None

    def _join(self, st: State, window: Node | None) -> DataFrame:
        keys: dict[str, str] = {}
        todo = [st.on] if st.on else []
        while todo:
            x = todo.pop()
            if x.kind == "binary" and x.op == "and":
                todo += [x.a, x.b]
            elif x.kind == "binary" and x.op == "==":
                keys.update({m.x.name: m.name for m in (x.a, x.b) if m.kind == "member"})
        sources = {b.alias: (self.scan(b.base), keys.get(b.alias, keys.get(b.base, "symbol"))) for b in st.join}
        return joins.latest_join(sources, window_micros=window.size.micros if window else joins.DEFAULT_WINDOW).withColumn("event_id", F.greatest(*[F.col(f"{a}.event_id") for a in sources]))

    # -- patterns

    def _key(self, st: State) -> str:
        """The field on which every step equals the first, by the steps' conditions or partition_by."""
        if st.key:
            return st.key
        found = [{f for f, rest in self._equalities(s.where, s.alias)} for s in st.steps[1:]]
        common = set.intersection(*found) if found else set()
        if common:
            return sorted(common)[0]
        return UNKEYED

    def _equalities(self, x: Node | None, own: str) -> list[tuple[str, Node | None]]:
        """(field, rest) for conditions `field == alias.field`."""
        out = []
        for c in self._conjuncts(x):
            if c.kind == "binary" and c.op == "==":
                for a, b in ((c.a, c.b), (c.b, c.a)):
                    if a.kind == "name" and b.kind == "member" and b.name == a.name and b.x.kind == "name" and b.x.name != own:
                        out.append((a.name, c))
        return out

    def _conjuncts(self, x: Node | None) -> list[Node]:
        if x is None:
            return []
        return self._conjuncts(x.a) + self._conjuncts(x.b) if x.kind == "binary" and x.op == "and" else [x]

    def _local(self, s: Node, key: str, df: DataFrame) -> tuple[Callable, list[Node]]:
        """The step's condition on its own event, and the conditions that compare with earlier aliases."""
        same = {id(c) for f, c in self._equalities(s.where, s.alias) if f == key}
        own, other = [], []
        for c in self._conjuncts(s.where):
            if id(c) in same:
                continue
            (other if self._mentions(c, s.alias) else own).append(c)

        def cond(get: Callable[[str], Column]) -> Column:
            scope = Scope(df, self.constants, self.functions, {n: get(n) for n in df.columns})
            out = F.array_contains(get("_types"), s.type)
            return functools.reduce(Column.__and__, [scope.column(c) for c in own], out)

        return cond, other

    def _mentions(self, x: object, own: str) -> bool:
        """Whether an expression has a member of another alias."""
        if isinstance(x, Node):
            if x.kind == "member" and x.x.kind == "name" and x.x.name != own and x.x.name in self._aliases:
                return True
            return any(self._mentions(v, own) for v in x.parts.values())
        return isinstance(x, (list, tuple)) and any(self._mentions(v, own) for v in x)

    def _united(self, types: list[str]) -> DataFrame:
        """Events of all the types with _types, the types and streams each belongs to."""
        names = list(dict.fromkeys(types))
        if self.events is not None and all(n not in self.streams and n not in self.tables for n in names):
            return self.events.where(F.col("event_type").isin(names)).withColumn("_types", F.array("event_type"))
        parts = [self.scan(n).withColumn("_types", F.array(F.lit(n))) for n in names]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _chain(self, st: State) -> DataFrame:
        self._aliases = {s.alias for s in st.steps}
        key, df = self._key(st), self._united([s.type for s in st.steps] + [n.type for n in st.nots])
        if key == UNKEYED:  # one key for all events, cut in time where there is a limit
            df = df.withColumn(UNKEYED, F.lit(0))
        conds = [self._local(s, key, df) for s in st.steps]
        barred = [self._local(Node("step", {"type": n.type, "where": n.where, "alias": "_not"}), key, df) for n in st.nots]
        if any(other for _, other in barred):
            raise ProgramError("a .not(...) may compare with earlier aliases on the key only")
        unless = patterns.either(*[c for c, _ in barred]) if barred else None
        if any(other for _, other in conds):
            return self._compared(st, key, df, conds)
        steps = [Step(s.alias, c, kleene=s.kleene in ("+", "*"), optional=s.kleene in ("?", "*")) for s, (c, _) in zip(st.steps, conds, strict=True)]
        if len(steps) == 2 and steps[1].kleene:
            a, b = df.where(steps[0].where(F.col)), df.where(steps[1].where(F.col))
            out = patterns.kleene_tail(a, b, key=key, within_micros=st.within or 10**15)
            return out.select(F.col("l").alias(steps[0].alias), F.col("r").alias(steps[1].alias), F.col("r.ts").alias("ts"), F.col("r.event_id").alias("event_id"))
        out = patterns.sequence(df, steps, key=key, within_micros=st.within, unless=unless, split=SLICE if key == UNKEYED and st.within else None)
        end = steps[-1].alias
        return out.withColumns({"ts": F.col(f"{end}.ts"), "event_id": F.col(f"{end}.event_id")})

    def _compared(self, st: State, key: str, df: DataFrame, conds: list) -> DataFrame:
        """Steps that compare with earlier aliases: one interval join for each step, first match by order."""
        if st.within is None or st.nots:
            raise ProgramError("steps that compare with earlier aliases need .within(...) and no .not(...)")
        first = st.steps[0].alias
        out = df.where(conds[0][0](F.col)).select(F.struct(*df.columns).alias(first), F.struct("ts", "event_id").alias("_prev"))
        for s, (cond, other) in zip(st.steps[1:], conds[1:], strict=True):
            own = df.where(cond(F.col)).select(F.struct(*df.columns).alias(s.alias))
            left = joins.bucketed(out.withColumn("_t", F.col(f"{first}.ts")), st.within, True, "_t")
            right = joins.bucketed(own.withColumn("_t2", F.col(f"{s.alias}.ts")), st.within, False, "_t2").withColumnRenamed("_bucket", "_b2")
            on = (F.col(f"{first}.{key}") == F.col(f"{s.alias}.{key}")) & (F.col("_bucket") == F.col("_b2")) & (F.struct(f"{s.alias}.ts", f"{s.alias}.event_id") > F.col("_prev")) & (windows.micros("_t2") <= windows.micros("_t") + st.within)
            scope = Scope(df, self.constants, self.functions, {n: F.col(f"{s.alias}.{n}") for n in df.columns} | {a.alias: F.col(a.alias) for a in st.steps})
            pairs = left.join(right, functools.reduce(Column.__and__, [scope.column(c) for c in other], on))
            done = [c for c in out.columns if c != "_prev"]
            out = pairs.groupBy(F.col(f"{first}.event_id").alias("_id")).agg(*[F.first(c).alias(c) for c in done], F.min_by(s.alias, F.struct(f"{s.alias}.ts", f"{s.alias}.event_id")).alias(s.alias)).drop("_id")
            out = out.withColumn("_prev", F.struct(f"{s.alias}.ts", f"{s.alias}.event_id"))
        end = st.steps[-1].alias
        return out.drop("_prev").withColumns({"ts": F.col(f"{end}.ts"), "event_id": F.col(f"{end}.event_id")})

    def _pattern(self, p: Node) -> DataFrame:
        """A named pattern."""
        body = p.body
        if body.kind in ("AND", "OR"):
            sides = [x.steps[0] for x in (body.a, body.b)]
            self._aliases = {s.alias for s in sides}
            df = self._united([s.type for s in sides])
            a, b = (self._local(s, p.key or "", df)[0] for s in sides)
            if body.kind == "AND":
                if p.key is None:
                    raise ProgramError("AND needs partition by")
                return patterns.both(df, a, b, key=p.key, within_micros=p.within or 10**15)
            return df.where(patterns.either(a, b)(F.col))
        steps = [s for s in body.steps if not s.negated]
        nots = [Node("not", {"type": s.type, "where": s.where}) for s in body.steps if s.negated]
        return self._chain(State(self.scan(steps[0].type), key=p.key, steps=steps, within=p.within, nots=nots))

    def _trend(self, s: Node, st: State, ops: list[Node]) -> DataFrame:
        if len(st.steps) != 2 or not st.steps[1].kleene or st.steps[0].kleene:
            return self._long_trend(s, st, ops)
        self._aliases = {x.alias for x in st.steps}
        key, df = self._key(st), self._united([x.type for x in st.steps])
        if key == UNKEYED:
            df = df.withColumn(UNKEYED, F.lit(0))
        a, b = (self._local(x, key, df)[0] for x in st.steps)
        items = next(o for o in ops if o.kind == "trend_aggregate").items
        value = next((x.args[0].name for x in items.values() if x.args and x.args[0].kind == "member"), None)
        micros = st.within or 60_000_000
        tagged = windows.tumbling_aligned(df, f"{micros} microseconds")
        out = trends.trends(tagged, a(F.col), b(F.col), F.col(value) if value else F.lit(None), by=[key, "w_start"])
        made = {"count_trends": "n_trends", "count_events": "n_events", "sum_trends": "sum_values", "avg_trends": "avg_value", "min_trends": "min_value", "max_trends": "max_value"}
        return out.select(F.lit(s.name).alias("stream"), key, "w_start", *[F.col(made[x.f.name]).alias(n) for n, x in items.items()])

    def _long_trend(self, s: Node, st: State, ops: list[Node]) -> DataFrame:
        """Trends over any chain of single and repeated steps: their number, and the events of a step in all of them."""
        self._aliases = {x.alias for x in st.steps}
        key, df = self._key(st), self._united([x.type for x in st.steps])
        if key == UNKEYED:
            df = df.withColumn(UNKEYED, F.lit(0))
        items = next(o for o in ops if o.kind == "trend_aggregate").items
        tagged = windows.tumbling_aligned(df, f"{st.within or 60_000_000} microseconds")
        counted = [x.args[0].name for x in items.values() if x.f.name == "count_events"]
        if unknown := sorted({x.f.name for x in items.values()} - {"count_trends", "count_events"}):
            raise ProgramError(f"{', '.join(unknown)} needs a trend of two steps")
        steps = [(x.alias, self._local(x, key, df)[0](F.col), x.kleene in ("+", "*")) for x in st.steps]
        out = trends.chain_trends(tagged, steps, by=[key, "w_start"], count=counted)
        return out.select(F.lit(s.name).alias("stream"), key, "w_start", *[F.col("n_trends" if x.f.name == "count_trends" else f"n_{x.args[0].name}").alias(n) for n, x in items.items()])
