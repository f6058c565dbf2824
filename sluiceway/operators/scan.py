"""Ordered scans: one pass over each key's rows in event order, with state that does not grow with the key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..shipping import ship
from .basic import ORDER

#: step(state or None, batch of one key's next rows) -> (state, new column)
Step = Callable[[object, pa.RecordBatch], tuple[object, pa.Array]]


def scan(df: DataFrame, keys: Sequence[str], step: Step, column: str, kind: str, *, order: Sequence[str] = ORDER) -> DataFrame:
    """The rows with a column that `step` computes along each key's rows in order.

    Rows are dealt out by key and sorted within partitions; a key's rows pass in batches, so a key may have any
    number of them. Without keys the stream is one sequence and one task reads it.
    """
    ship(df.sparkSession)
    n = len(df.columns)
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("default")) for k, c in zip(names, keys, strict=True)})
    dealt = (keyed.repartition(*names) if names else keyed.repartition(1)).sortWithinPartitions(*names, *order)
    schema = df.withColumn(column, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held, state = len(names), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = list(zip(*[batch.column(n + i).to_pylist() for i in range(width)], strict=True)) or [()] * batch.num_rows
            new, at = [], 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or ids[k] != ids[at]:
                    if ids[at] != held:
                        held, state = ids[at], None
                    state, made = step(state, batch.slice(at, k - at))
                    new.append(made)
                    at = k
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.concat_arrays(new)], names=[*batch.schema.names[:n], column])

    return dealt.mapInArrow(run, schema)


def fold(df: DataFrame, by: Sequence[str], start: Callable[[], list], step: Callable[..., None], done: Callable[[list], Sequence[object]], schema: str, *, order: Sequence[str] = ORDER) -> DataFrame:
    """A row for each group of `by`: its columns and what `done` makes of a state that `step(state, *other columns)` changed row by row, in order.

    Rows are dealt out by group and sorted within partitions, so a group of any number of rows takes the memory of
    its state. df holds the columns of `by`, those of `order`, then those for `step`.
    """
    ship(df.sparkSession)
    width, skip = len(by), len(by) + len(order)
    dealt = df.repartition(*by).sortWithinPartitions(*by, *order)
    whole = StructType([*df.select(*by).schema.fields, *StructType.fromDDL(schema).fields])
    names, types = whole.names, [to_arrow_type(f.dataType) for f in whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, None, []

        def full() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            keys = zip(*[batch.column(i).to_pylist() for i in range(width)], strict=True)
            rows = zip(*[batch.column(i).to_pylist() for i in range(skip, batch.num_columns)], strict=True)
            for key, row in zip(keys, rows, strict=True):
                if state is None or key != held:
                    if state is not None:
                        out.append((*held, *done(state)))
                    held, state = key, start()
                step(state, *row)
            if len(out) >= 4096:
                yield full()
        if state is not None:
            out.append((*held, *done(state)))
        if out:
            yield full()

    return dealt.mapInArrow(run, whole)
