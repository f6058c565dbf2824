"""Token ids in binary files of patched frame-of-reference blocks.

The writer sorts documents by id over range partitions; each task encodes its documents and writes one file:

    "SPF1", unsigned 32-bit block length
    blocks: unsigned 32-bit minimum, 8-bit width, 8-bit count of exceptions,
            the low `width` bits of each value less the minimum, packed little-endian,
            exceptions: 8-bit positions, then unsigned 32-bit values less the minimum
    unsigned 64-bit start of each block
    for each document: 64-bit id (see `flags`), unsigned 32-bit count of ids; 8-bit flags (1: the id is null)
    trailer: unsigned 64-bit counts of blocks, values and documents, "SPF1"

A block's width is that of the percentile chosen (PERCENTILE) of its values less the minimum; larger values
are exceptions. Every task writes under a name of its own and reports it; the manifest (a Parquet table of
partition, file, documents and ids) is written once all have ended and names the files that count, so a
repeated or lost attempt leaves no trace in what is read. A read goes by the manifest, streams the blocks,
and knows each document's place in the whole from the sums of the partitions before it.

Null and empty texts have the end id alone; null ids come first and stay null; rows with equal ids stay, in
the order of their texts; an empty table gives a manifest without ids; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import scratch, small_batches, table

MAGIC, BLOCK, PERCENTILE, END = b"SPF1", 128, 0.9, 2

#: Blocks that are packed or unpacked at a time.
CHUNK = 8_192


def _width(x: np.ndarray) -> np.ndarray:
    """Bits that values below 2**32 need."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(values: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of unsigned 32-bit values (the last one filled up with its minimum), and each block's size."""
    n = -(-len(values) // BLOCK)
    x = np.empty(n * BLOCK, np.uint32)
    x[: len(values)] = values
    if len(values) < len(x):
        x[len(values) :] = values[(n - 1) * BLOCK :].min()
    x = x.reshape(n, BLOCK)
    low = x.min(1)
    d = x - low[:, None]
    rank = min(BLOCK - 1, int(percentile * BLOCK))
    width = _width(np.partition(d, rank, axis=1)[:, rank])
    over = d.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    found = over.sum(1)
    sizes = 6 + BLOCK // 8 * width + 5 * found
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[starts + 4], out[starts + 5] = width, found
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        part = np.ascontiguousarray(d[rows].T).astype(np.uint64) & np.uint64((1 << int(w)) - 1)
        body = np.zeros((BLOCK * int(w) // 32 + 1, len(rows)), np.uint64)
        for j in range(BLOCK):
            word, bit = divmod(j * int(w), 32)
            both = part[j] << np.uint64(bit)
            body[word] |= both & np.uint64(0xFFFFFFFF)
            body[word + 1] |= both >> np.uint64(32)
        flat = np.ascontiguousarray(body[:-1].T).astype("<u4").view(np.uint8)
        out[starts[rows][:, None] + 6 + np.arange(flat.shape[1])] = flat
    row, col = np.nonzero(over)
    if len(row):
        kth = np.arange(len(row)) - np.repeat(np.cumsum(found) - found, found)
        at = (starts + 6 + BLOCK // 8 * width)[row]
        out[at + kth] = col
        out[(at + found[row] + 4 * kth)[:, None] + np.arange(4)] = d[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), sizes


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The values of the blocks that start at the given places of raw."""
    b, n = np.frombuffer(raw, np.uint8), len(starts)
    low = np.ascontiguousarray(b[starts[:, None] + np.arange(4)]).view("<u4").reshape(n)
    width, found = b[starts + 4].astype(np.int64), b[starts + 5].astype(np.int64)
    d = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        words = np.ascontiguousarray(b[starts[rows][:, None] + 6 + np.arange(BLOCK // 8 * int(w))]).view("<u4")
        words = np.vstack([np.ascontiguousarray(words.T).astype(np.uint64), np.zeros((1, len(rows)), np.uint64)])
        part, mask = np.empty((BLOCK, len(rows)), np.uint32), np.uint64((1 << int(w)) - 1)
        for j in range(BLOCK):
            word, bit = divmod(j * int(w), 32)
            part[j] = ((words[word] | words[word + 1] << np.uint64(32)) >> np.uint64(bit)) & mask
        d[rows] = part.T
    if found.any():
        row = np.repeat(np.arange(n), found)
        kth = np.arange(len(row)) - np.repeat(np.cumsum(found) - found, found)
        at = (starts + 6 + BLOCK // 8 * width)[row]
        d[row, b[at + kth]] = np.ascontiguousarray(b[(at + found[row] + 4 * kth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    return (d + low[:, None]).reshape(-1)


def _open(path: str):  # noqa: ANN202
    """The file system of a URL that executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """One file, written as values come; memory holds a chunk of blocks and the indexes."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC + struct.pack("<I", BLOCK))
        self.waiting, self.held, self.values = [], 0, 0
        self.sizes: list[np.ndarray] = []
        self.ids, self.counts, self.nulls = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= CHUNK * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        x = np.frombuffer(b"".join(self.waiting), "<u4")
        for at in range(0, n, CHUNK * BLOCK):
            raw, sizes = encode_blocks(x[at : min(n, at + CHUNK * BLOCK)])
            self.out.write(raw)
            self.sizes.append(sizes)
        self.waiting, self.held = [x[n:].tobytes()], len(x) - n
        self.values += n

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        sizes = np.concatenate([*self.sizes, np.zeros(0, np.int64)]).astype(np.int64)
        self.out.write((8 + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
        self.out.write(np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes() + np.array(self.nulls, np.uint8).tobytes())
        self.out.write(struct.pack("<QQQ", len(sizes), self.values, len(self.ids)) + MAGIC)
        self.out.close()


def read_file(path: str) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each document of one file, in order."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        size = f.size()
        tail = f.read_at(28, size - 28)
        blocks, values, docs = struct.unpack("<QQQ", tail[:24])
        if tail[24:] != MAGIC or f.read_at(8, 0) != MAGIC + struct.pack("<I", BLOCK):
            raise ValueError(f"{path} is no token file")
        table_at = size - 28 - 13 * docs
        ids = np.frombuffer(f.read_at(8 * docs, table_at), "<i8")
        counts = np.frombuffer(f.read_at(4 * docs, table_at + 8 * docs), "<u4").astype(np.int64)
        nulls = np.frombuffer(f.read_at(docs, table_at + 12 * docs), np.uint8)
        starts = np.frombuffer(f.read_at(8 * blocks, table_at - 8 * blocks), "<u8").astype(np.int64)
        ends = np.append(starts[1:], table_at - 8 * blocks)
        k, waiting, held, left = 0, [], 0, values
        for doc_id, count, null in zip(ids.tolist(), counts.tolist(), nulls.tolist(), strict=True):
            while held < count:
                upto = min(k + CHUNK, blocks)
                x = decode_blocks(f.read_at(int(ends[upto - 1] - starts[k]), int(starts[k])), starts[k:upto] - starts[k])[:left]
                left, k, held = left - len(x), upto, held + len(x)
                waiting.append(x)
            if len(waiting) > 1:
                waiting = [np.concatenate(waiting)]
            one = waiting[0][:count] if count else np.zeros(0, np.uint32)
            if count:
                waiting[0] = waiting[0][count:]
            held -= count
            yield (None if null else doc_id), one.astype("<u4").tobytes()


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end: int = END, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Writes the ids of all texts, documents in ascending order of id, to token files and a manifest under `path`."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, out = TaskContext.get().partitionId(), encoder(tokenizer), None
        name = f"part-{part:06d}-{uuid.uuid4().hex}.spf"
        for batch in batches:
            out = out or Writer(f"{path}/ids/{name}")
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            for one, ids in zip(batch.column(0).to_pylist(), made.encode_many(texts, end), strict=True):
                out.add(one, ids)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": len(out.ids), "n_ids": out.values}])

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part long, file string, n_docs long, n_ids long").write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, read from the files that the manifest names.

    The driver sums one row for each partition written.
    """
    small_batches(spark)
    rows = spark.read.parquet(f"{path}/manifest").orderBy("part").collect()
    starts = np.cumsum([0] + [r.n_ids for r in rows]).tolist()
    files = spark.createDataFrame([(f"{path}/ids/{r.file}", s) for r, s in zip(rows, starts, strict=False)], "file string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out, size = [], 0
                for doc_id, ids in read_file(name):
                    out.append((doc_id, start, len(ids) // 4, ids))
                    start, size = start + len(ids) // 4, size + len(ids)
                    if size > 8 << 20 or len(out) >= 4096:
                        yield made(out)
                        out, size = [], 0
                if out:
                    yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    return files.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_token_file": op2_token_file}
