import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from sluiceway.streaming.queries import ROCKSDB

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config(map=ROCKSDB).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def same_rows(spark_rows, duck_rows):
    """Rows as sorted tuples, columns by name, floats to nine digits."""
    columns = sorted(spark_rows.columns)
    assert columns == sorted(duck_rows.columns)

    def cells(pdf):
        made = pdf[columns].astype(object).where(pdf[columns].notna(), None)
        return sorted((tuple(None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in made.values.tolist()), key=str)

    assert cells(spark_rows) == cells(duck_rows)


@pytest.fixture(scope="session")
def same():
    return same_rows
