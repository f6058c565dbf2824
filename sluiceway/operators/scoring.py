"""Model scores as columns: a model is loaded once for each Python worker and gets Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Makes the model on an executor: a function from a (rows, inputs) array to a (rows, outputs) array.
Loader = Callable[[], Callable[[np.ndarray], np.ndarray]]


def onnx(path: str) -> Loader:
    """A model file that every executor can open; its first input takes float rows."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name
        return lambda x: np.asarray(session.run(None, {name: x.astype(np.float32)})[0])

    return load


def score(df: DataFrame, loader: Loader, *, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """The rows with double columns `outputs`. Missing inputs count as 0; rows a model fails on get null scores."""
    ship(df.sparkSession)
    n, count = len(df.columns), len(outputs)
    schema = df.withColumns({o: F.lit(None).cast("double") for o in outputs}).schema
    names = [*df.columns, *outputs]
    fed = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{k}") for k, c in enumerate(inputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loader()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n, batch.num_columns)])
            try:
                y = np.asarray(model(x), np.float64).reshape(len(x), count)
                new = [pa.array(y[:, k]) for k in range(count)]
            except Exception:  # whatever a model raises: the events pass without scores
                new = [pa.nulls(len(x), pa.float64())] * count
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=names)

    return fed.mapInArrow(run, schema)
