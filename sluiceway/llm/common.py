"""What the corpus operators share: reading tables, the shared work folder, checkpoints, batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows and bytes of one Arrow batch handed to Python, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20

#: Words are maximal runs without ASCII white space.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Spark would resolve it to, so that Python workers write to the same place."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(made).toString().rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset one of our own, in local mode only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (held := sc.getCheckpointDir()):
        return held.rstrip("/")
    if not found and not sc.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='sluiceway-')}")
    return _qualified(spark, found or sc.getCheckpointDir())


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for one table or set of files, removed when the driver ends."""
    path = f"{work_dir(spark)}/sluiceway/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(clear)
    _scratch.append((spark._jvm, spark._jsc.hadoopConfiguration(), path))
    return path


_scratch: list[tuple] = []


def clear() -> None:
    """Removes the scratch folders of this driver; what was read from them must have been used."""
    while _scratch:
        jvm, conf, path = _scratch.pop()
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already
            made = jvm.org.apache.hadoop.fs.Path(path)
            made.getFileSystem(conf).delete(made, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared checkpoint folder; lost executors do not lose them."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but as a Parquet table, for wide rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes for the Python operators of this session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow of a function on single batches."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def packed(df: DataFrame, **parts: Column | str) -> DataFrame:
    """The whole input row as the struct `row`, beside named parts: names of the input cannot clash with ours."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[(F.col(f"`{v}`") if isinstance(v, str) else v).alias(k) for k, v in parts.items()])


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The input row's columns, those named in `new` replaced in place or added at the end."""
    kept = [new.get(c, F.col("row").getField(c)).alias(c) for c in columns]
    return df.select(*kept, *[v.alias(k) for k, v in new.items() if k not in columns])


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")
