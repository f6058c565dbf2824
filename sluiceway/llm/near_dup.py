"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint is the 64-bit majority of the XXH64 hashes of its three-word shingles. Two
fingerprints are linked when at most three bits differ. The 64 bits are cut into two segments: of three
differing bits, one segment holds at most one. Each distinct fingerprint therefore puts both segments into
an index, once as they are and once with each single bit masked; an equality join on (segment, masked bit,
rest) finds every link, and the join condition verifies the distance and reports a pair in one place only.
Buckets over HOT fingerprints are cut again by the same rule on the other segment's halves, so that no
bucket of a dense group is compared as a whole.

Null and blank texts have fingerprint zero and are linked like any other; very long texts are hashed whole; rows
with a null id keep their fingerprint and take the smallest id of their component, null if there is none; ids are
compared by size, so there are no ties; repeated rows stay; an empty table gives no rows; `one_of_each` passes all
columns through, whatever their names, the others read the named columns only.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, packed, per_batch, table, unpacked

BITS, DISTANCE, SHINGLE = 64, 3, 3

#: A segment value that more distinct fingerprints share is indexed at the second level too.
HOT = 2_000

#: Tables of fingerprints or nodes are broadcast through the driver up to so many rows (about 4 MB), merge joined beyond.
BROADCAST_ROWS = 50_000

_WORDS = re.compile(rb"[^ \t-\r]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned integer."""
    import xxhash

    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words)) - 1
    spans = zip(starts[: len(words) - k].tolist(), ends[k:].tolist(), strict=True)
    h, n = xxhash.xxh64_intdigest, len(words) - k
    ones = np.zeros(BITS, np.int64)
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in spans), np.uint64, n)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint_of(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return per_batch(source, run, "doc_id long, fp long")


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))


def _bits(x: Column) -> Column:
    return F.bit_count(x)


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """One side of a join that has at most so many rows, with the way to join it. Spark's own choice goes by bytes of serialized rows, a third of what the driver then holds."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def links(fps: DataFrame, *, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints of column fp that differ in 1 to `distance` bits, each pair once."""
    if distance != 3:
        raise ValueError("two segments serve a distance of 3")
    values = fps.select("fp").distinct()
    one = F.lit(1).cast("long")

    def entries(s: int) -> Column:
        """The exact entry (bit -1) and the 32 masked entries of segment s, with the masked bit's value."""
        seg = _segment(F.col("fp"), s)
        exact = F.struct(F.lit(64 + s).cast("int").alias("tag"), seg.alias("rest"), F.lit(2).alias("side"))
        masked = F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: F.struct(
                (i + 32 * s).cast("int").alias("tag"),
                seg.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, i))).alias("rest"),
                F.getbit(seg, i).cast("int").alias("side"),
            ),
        )
        return F.concat(F.array(exact), masked)

    index = values.select("fp", F.explode(F.concat(entries(0), entries(1))).alias("e")).select("fp", "e.tag", "e.rest", "e.side")
    index = index.withColumns({"sub": F.lit(-1), "part": F.lit(0).cast("long")})

    crowded = values.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col("fp"), s).alias("v")) for s in (0, 1)])).alias("e")).groupBy("e.s", "e.v").count().where(F.col("count") > hot)
    crowded = cut(crowded.select("s", "v"))
    if n_crowded := crowded.count():
        keys = crowded.select(
            F.explode(
                F.concat(
                    F.array(F.struct((F.col("s") + 64).alias("tag"), F.col("v").alias("rest"))),
                    F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((i + 32 * F.col("s")).alias("tag"), F.col("v").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, i))).alias("rest"))),
                )
            ).alias("e")
        ).select(F.col("e.tag").cast("int").alias("tag"), "e.rest").distinct().withColumn("dense", F.lit(True))
        index = index.join(_bounded(keys, 33 * n_crowded), ["tag", "rest"], "left")
        other = F.when(F.col("tag") >= 64, 65 - F.col("tag")).otherwise(1 - F.floor(F.col("tag") / 32)).cast("int")
        rest = F.call_function("shiftrightunsigned", F.col("fp"), other * 32).bitwiseAND(F.lit(0xFFFFFFFF))

        def halves(h: int) -> Column:
            half = F.shiftrightunsigned(rest, 16 * h).bitwiseAND(F.lit(0xFFFF))
            masked = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.struct((j + 16 * h).cast("int").alias("sub"), half.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, j))).alias("part")))
            return F.concat(F.array(F.struct(F.lit(64 + h).cast("int").alias("sub"), half.alias("part"))), masked)

        plain = F.array(F.struct(F.lit(-1).cast("int").alias("sub"), F.lit(0).cast("long").alias("part")))
        index = index.select("fp", "tag", "rest", "side", F.explode(F.when(F.col("dense"), F.concat(halves(0), halves(1))).otherwise(plain)).alias("e")).select("fp", "tag", "rest", "side", "e.sub", "e.part")

    a = index.where(F.col("side") != 1).select(F.col("fp").alias("a"), *[F.col(c) for c in ("tag", "rest", "sub", "part")])
    b = index.where(F.col("side") != 0).select(F.col("fp").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("tag", "rest", "sub", "part")])
    x = F.col("a").bitwiseXOR(F.col("b"))
    d0, d1 = _bits(_segment(x, 0)), _bits(_segment(x, 1))
    #: Where a pair is reported: at an equal segment, else at the single differing bit of the first segment that has one.
    exact = (F.col("tag") >= 64) & (F.col("a") < F.col("b"))
    masked = (F.col("tag") < 64) & (d0 > 0) & (d1 > 0) & ((F.col("tag") < 32) | (d0 > 1))
    far = F.when((F.col("tag") == 64) | (F.col("tag") < 32), _segment(x, 1)).otherwise(_segment(x, 0))
    h0, h1 = _bits(far.bitwiseAND(F.lit(0xFFFF))), _bits(F.shiftrightunsigned(far, 16))
    bit = F.log2(F.when(F.col("sub") < 16, far.bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned(far, 16)))
    sub = (
        F.when(F.col("sub") < 0, True)
        .when(h0 == 0, F.col("sub") == 64)
        .when(h1 == 0, F.col("sub") == 65)
        .when(h0 == 1, (F.col("sub") < 16) & (bit == F.col("sub")))
        .otherwise((F.col("sub") >= 16) & (F.col("sub") < 32) & (bit == F.col("sub") - 16))
    )
    on = [F.col(c) == F.col(f"{c}_b") for c in ("tag", "rest", "sub", "part")]
    #: Spark takes an exploded row for as small as the row it came from, and would broadcast an index of 66 entries a fingerprint by the size of the fingerprints.
    return a.join(b.hint("merge"), functools.reduce(Column.__and__, [*on, _bits(x) <= distance, exact | masked, sub])).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of the pairs (a, b): node, root (the smallest node), for the nodes of pairs.

    Alternating large and small stars: in each round every node is tied to the smallest node it knows.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    nodes = edges.select(F.explode(F.array("u", "v"))).distinct().count()  # no round makes more
    for _ in range(64):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _bounded(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), nodes)
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(edges.join(low, F.col("u") == F.col("k")).select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = _bounded(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), nodes)
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = cut(small)
        if small.unionAll(edges).groupBy("u", "v").count().where("count <> 2").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(small.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        edges = small
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links, for every row."""
    rows = cut(fingerprints(docs, doc_id=doc_id, text=text))
    values = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    n_values = values.count()
    roots = cut(components(links(values, hot=hot)))
    n_roots = roots.count()
    known = _bounded(roots, n_roots)
    rooted = values.join(known, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    moved = values.join(known, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("least_id").alias("group_id")).withColumnRenamed("root", "r")
    named = rooted.join(_bounded(moved, n_roots), F.col("root") == F.col("r"), "left").select(F.col("fp").alias("f"), F.coalesce("group_id", "least_id").alias("component_id"))
    return rows.join(_bounded(named, n_values), F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids to drop are broadcast up to so many (8 bytes each), joined by shuffle beyond.
BROADCAST_IDS = 500_000


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id is the smallest of their near-duplicate component; rows without an id stay.

    Rows with equal doc_id stay or go together: they stay if one of them is to stay.
    """
    stays = F.max(F.col("doc_id") == F.col("component_id"))
    dropped = cut(near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(stays.alias("stays")).where("NOT stays").select(F.col("doc_id").alias("dropped_id")))
    bounded = dropped.count() <= BROADCAST_IDS
    rows = packed(docs, id=F.col("doc_id").cast("long"))
    return unpacked(rows.join(F.broadcast(dropped) if bounded else dropped, F.col("id") == F.col("dropped_id"), "left_anti"), docs.columns)


QUERIES = {"op10_simhash": op10_simhash}
