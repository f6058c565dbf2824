"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it, divided by the
host's page total; lines above the ratio are boilerplate and dropped. `min_pages` is the least number of pages
that makes a line repeated at all: every line of a host's only page has the ratio 1, and two is the least that
says anything. Lines are what "\\n" separates, compared without blanks, tabs and "\\r" at their ends; blank lines
never count and are never dropped. A page all of whose lines are boilerplate becomes empty and stays as a row;
with `spare_whole` it keeps its text, for document-level dedup to decide (as in the pipeline, where a group of
copies would otherwise lose its text before one of them can be chosen).

Null texts stay null and count as pages without lines, empty texts stay empty; a null host is a host of its own;
very long texts are cut into lines whole; repeated rows are pages of their own; a line at exactly the ratio stays;
all columns pass through, whatever their names (an n_lines or n_dropped of the input is replaced); an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, packed, table, unpacked

RATIO, MIN_PAGES = 0.02, 2

#: A list of boilerplate lines up to so many entries (32 hex digits each) is broadcast, a longer one is joined by shuffle,
#: and each host's pages then go to one of SALTS copies of its list.
BROADCAST_LINES, SALTS = 200_000, 32

_ENDS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """A 128-bit name of the line, null for blank lines."""
    bare = F.btrim(line, F.lit(_ENDS))
    return F.when(bare != "", F.md5(bare))


def boilerplate(pages: DataFrame, *, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, lines (array of the keys of its boilerplate lines), for hosts that have some.

    A host has at most (mean lines of a page) / ratio of them.
    """
    rows = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _key), lambda k: k.isNotNull()))
    counts = rows.select("host", F.explode(keys).alias("hex")).select("host", F.unhex("hex").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    named = totals.select(F.col("host").alias("h"), "pages")
    over = counts.join(named, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy("host").agg(F.sort_array(F.collect_list(F.lower(F.hex("line")))).alias("lines"))


def drop_boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, spare_whole: bool = False) -> DataFrame:
    """The pages with their columns, `text` without boilerplate lines, and n_lines, n_dropped (of lines with content)."""
    found = cut(boilerplate(pages, host=host, text=text, ratio=ratio, min_pages=min_pages))
    size = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    named = found.select(F.col("host").alias("h"), F.col("lines").alias("boilerplate"))
    rows = packed(pages, host=host, text=text)
    if size <= BROADCAST_LINES:
        rows = rows.join(F.broadcast(named), F.col("host").eqNullSafe(F.col("h")), "left")
    else:
        salted = named.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
        rows = rows.join(salted, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("copy")), "left")
    tagged = F.transform(_lines(F.col("text")), lambda x: F.struct(x.alias("line"), _key(x).alias("key")))
    rows = rows.withColumn("tagged", F.when(F.col("text").isNotNull(), tagged))
    rows = rows.withColumn("kept", F.when(F.col("boilerplate").isNull(), F.col("tagged")).otherwise(F.filter("tagged", lambda x: x["key"].isNull() | ~F.array_contains(F.col("boilerplate"), x["key"]))))
    full = lambda c: F.size(F.filter(c, lambda x: x["key"].isNotNull()))
    rows = rows.select("row", "text", "kept", F.coalesce(full(F.col("tagged")), F.lit(0)).alias("n_lines"), F.coalesce(full(F.col("kept")), F.lit(0)).alias("n_kept"))
    drops = (F.col("n_kept") < F.col("n_lines")) & ((F.col("n_kept") > 0) | F.lit(not spare_whole))
    return unpacked(
        rows,
        pages.columns,
        **{
            text: F.when(drops, F.array_join(F.transform("kept", lambda x: x["line"]), "\n")).otherwise(F.col("text")),
            "n_lines": F.col("n_lines").cast("long"),
            "n_dropped": F.when(drops, F.col("n_lines") - F.col("n_kept")).otherwise(0).cast("long"),
        },
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", "text")


SQL = f"""
WITH rows AS (SELECT doc_id, source, text FROM documents),
lines AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows)
),
totals AS (SELECT source, count(*) AS pages FROM rows GROUP BY source),
over AS (
  SELECT c.source, c.bare FROM (SELECT source, bare, count(DISTINCT doc_id) AS n FROM lines WHERE bare <> '' GROUP BY source, bare) c
  JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND n > CAST({RATIO} AS DOUBLE) * pages
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, l.bare <> '' AS has_content, o.bare IS NOT NULL AS boilerplate
  FROM lines l LEFT JOIN over o ON l.source IS NOT DISTINCT FROM o.source AND l.bare = o.bare
),
pages AS (
  SELECT doc_id, count(*) FILTER (has_content) AS n_lines, count(*) FILTER (boilerplate) AS n_over,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT boilerplate) AS rest
  FROM marked GROUP BY doc_id
)
SELECT r.doc_id, r.source, coalesce(n_lines, 0) AS n_lines,
       coalesce(n_over, 0) AS n_dropped, CASE WHEN n_over > 0 THEN coalesce(rest, '') ELSE r.text END AS text
FROM rows r LEFT JOIN pages p ON r.doc_id = p.doc_id
"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": SQL}
