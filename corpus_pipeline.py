"""The corpus pipeline: five stages of the corpus operators, each written as Parquet and reread by the next.

Documents with a null or blank text have no language and go in the first stage; an empty table gives no rows.
Rows with a null id stay, each for itself, and are packed under it; repeated rows are near copies with one id, so
they stay together. Texts of any length go through whole. Ties are settled by id. The first four stages pass all
columns through; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import decontaminate, language, line_dedup, near_dup, packing
from sluiceway.llm.common import table, written


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return language.recognised(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source are taken out of its documents; every document stays, one of such lines alone as it is."""
    columns = docs.columns
    return line_dedup.drop_boilerplate(docs, spare_whole=True).withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into training sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("language", recognise_language),
    ("line_dedup", drop_lines),
    ("near_dup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]

#: The stages hold trained models, BM25 retrieval and packing; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
