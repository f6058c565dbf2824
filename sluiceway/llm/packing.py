"""Cost-balanced packing of token ids into sequences.

A document's ids are cut into pieces of a full sequence and one remainder. Full pieces are sequences by
themselves. Remainders are packed in groups: a group opens as many sequences as its tokens fill, and its
pieces, longest first, go to the sequence of the lowest estimated cost (linear in tokens plus quadratic in
the length of each piece, as attention is) that still has room. Where no open sequence has room for the
whole piece, the piece is cut at the lowest one's end, and the rest takes its turn by its length. What is left over at the end of a partition fills
sequences whose lengths are powers of two, so nothing is padded.

Packing needs no shuffle: each partition packs its own documents and numbers its sequences within a range
of its own, so a lost partition is rebuilt alike. Null and empty texts have the end id alone; null ids stay
null; repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import small_batches, table

LENGTH, END = 2048, 1

#: Cost of a sequence: LINEAR * tokens + QUADRATIC * sum of squared piece lengths.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096

#: Sequences that a group opens.
GROUP = 512

#: Sequence ids of a partition start at partition << SHIFT.
SHIFT = 40

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"


class Piece:
    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id: int | None, start: int, doc_tokens: int, ids: memoryview):
        self.doc_id, self.start, self.doc_tokens, self.ids = doc_id, start, doc_tokens, ids

    def __len__(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.doc_tokens, self.ids[: 4 * n]), Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[4 * n :])


def balance(pieces: list[Piece], rooms: list[int], *, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[list[Piece]], list[Piece]]:
    """Deals pieces to sequences of the given rooms: what each got, and the pieces left when all are full."""
    got: list[list[Piece]] = [[] for _ in rooms]
    room = list(rooms)
    order = lambda p: (len(p), 1 if p.doc_id is None else -p.doc_id, -p.start)
    todo = sorted(pieces, key=order)
    # Pieces only get shorter, so a sequence without room for one is parked by its room until they fit again.
    heap, parked = [(0.0, k) for k in range(len(rooms))], []
    while todo and (heap or parked):
        piece = todo.pop()
        while parked and -parked[0][0] >= len(piece):
            heapq.heappush(heap, heapq.heappop(parked)[1:])
        while heap and room[heap[0][1]] < len(piece):
            cost, k = heapq.heappop(heap)
            heapq.heappush(parked, (-room[k], cost, k))
        if heap:
            cost, k = heapq.heappop(heap)
        else:
            _, cost, k = one = min(parked, key=lambda x: x[1:])
            parked.remove(one)
            heapq.heapify(parked)
            piece, rest = piece.split(room[k])
            bisect.insort(todo, rest, key=order)
        got[k].append(piece)
        room[k] -= len(piece)
        if room[k]:
            heapq.heappush(heap, (cost + linear * len(piece) + quadratic * len(piece) ** 2, k))
    return got, todo


class Packer:
    """Packs the documents of one partition as they come; sequence ids count up from `first`."""

    def __init__(self, first: int, length: int = LENGTH):
        self.next, self.length = first, length
        self.held: list[Piece] = []
        self.held_tokens = 0

    def _emit(self, pieces: list[Piece]) -> Iterator[tuple]:
        at, total = 0, sum(map(len, pieces))
        for p in pieces:
            yield p.doc_id, p.start, len(p), p.doc_tokens, self.next, at, total, bytes(p.ids)
            at += len(p)
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n, view = len(ids) // 4, memoryview(ids)
        whole = n // self.length * self.length
        for at in range(0, whole, self.length):
            yield from self._emit([Piece(doc_id, at, n, view[4 * at : 4 * (at + self.length)])])
        if whole < n:
            self.held.append(Piece(doc_id, whole, n, view[4 * whole :]))
            self.held_tokens += n - whole
        if self.held_tokens >= GROUP * self.length:
            yield from self._pack([self.length] * GROUP)

    def _pack(self, rooms: list[int]) -> Iterator[tuple]:
        got, self.held = balance(self.held, rooms)
        self.held_tokens = sum(map(len, self.held))
        for pieces in got:
            if pieces:
                yield from self._emit(pieces)

    def close(self) -> Iterator[tuple]:
        rooms = [self.length] * (self.held_tokens // self.length)
        rest = self.held_tokens % self.length
        rooms += [1 << b for b in range(self.length.bit_length()) if rest >> b & 1]
        yield from self._pack(rooms)


def pack(docs: DataFrame, *, tokenizer: str, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: see SCHEMA; ids holds the piece's ids as little-endian unsigned 32-bit integers.

    `length` is a power of two.
    """
    if length & (length - 1):
        raise ValueError("the sequence length is a power of two")
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64()] * 7 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << SHIFT, length)
        out: list[tuple] = []

        def full(least: int) -> Iterator[pa.RecordBatch]:
            while len(out) >= least and out:
                part, out[:] = out[:4096], out[4096:]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

        for batch in batches:
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            for one, ids in zip(batch.column(0).to_pylist(), made.encode_many(texts, end), strict=True):
                out.extend(packer.add(one, ids))
            yield from full(4096)
        out.extend(packer.close())
        yield from full(1)

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digest(pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
