"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Items are cut into sections of at most SECTION words and indexed: for each term its postings (cursors run over
them in the order of sections), with the term's BM25 impact on a section divided by the section's greatest
possible score. A score is then the weighted share of a section that a passage holds, and one threshold serves
all. Sections are laid out in blocks; the index keeps each term's greatest impact in the whole and in each block.
Every passage of every document (a window of two spans of SECTION words, moving by one span, so that any section
lies within a window) is a query. Bounds over ranges of blocks, added up for all windows of a text at once, leave
out the windows that can reach the threshold nowhere; for the others the sum of the block maxima of all terms leaves
the live blocks, and the cursors are set to the first of these. Then WAND: the cursors stand sorted by
section, the pivot is the first section whose cursors' greatest impacts reach the threshold together; where the
block is not live, or the maxima of these cursors do not reach it there, the cursors before jump past the block (or to the next cursor), else they jump
to the pivot, which is scored exactly once all stand there. What is jumped over is never read. All (window,
section) pairs at the threshold are retrieved. A document and item are reported if, around the windows found, the
item's question and its answer both overlap: the share of each part's word n-grams that occur there.

The question is the item's text up to its last "?", else the first half of its words; the answer is the rest.
An item of fewer than SHORTEST words cannot be told from ordinary prose by its words: it is not searched for
(`too_short` lists such items, for an exact rule of one's own).

Items go in index shards of at most SHARD sections (or one item, if that is longer). The documents are read once:
every batch is searched in one shard after the other, and a worker holds the last HELD shards it used. The driver
reads the items one at a time and holds one shard and the items' vocabulary.

Null and blank texts hold no passage and null or blank items match nothing; very long texts are searched whole,
window by window; items with equal texts are all reported, and ties need no order; rows with equal doc_id are
searched as rows of their own, null ids stay null; empty tables give no rows; other columns are not read by
`leaks` and pass through `clean` under their names.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Blocks of an index, ranges of blocks whose maxima leave out windows, sections of a shard, shards a worker holds.
SECTION, BLOCKS, RANGES, SHARD, HELD = 64, 256, 32, 512, 4
K1, B = 1.2, 0.75

#: Least share of a section's score that a window must reach, and least overlap of question and answer.
THRESHOLD, OVERLAP, NGRAM = 0.5, 0.5, 5

#: Words of the shortest item that is searched for.
SHORTEST = 8

#: Bounds are compared with this much to spare, as their sums are rounded.
SPARE = 1e-4

_TERM = re.compile(r"\w+")

FOUND = "item_id long, score double, question_overlap double, answer_overlap double, first_word long, windows long"


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Terms of the question and of the answer."""
    at = text.rfind("?")
    if at >= 0 and terms_of(text[: at + 1]) and terms_of(text[at + 1 :]):
        return terms_of(text[: at + 1]), terms_of(text[at + 1 :])
    terms = terms_of(text)
    return terms[: (len(terms) + 1) // 2], terms[(len(terms) + 1) // 2 :]


def grams(terms: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)}


def overlap(part: list[str], around: list[str], n: int = NGRAM) -> float:
    """Share of the part's n-grams (shorter parts: their whole sequence) that occur around; 1 for an empty part."""
    if not part:
        return 1.0
    n = min(n, len(part))
    own = grams(part, n)
    return len(own & grams(around, n)) / len(own)


class Index:
    """Inverted index of the sections of some items, with block maxima. `read` counts the postings that searches read, `passed` those they jumped over."""

    def __init__(self, items: list[tuple[int | None, str]], *, stats: tuple[int, float, dict[str, int]], threshold: float = THRESHOLD):
        n, mean, df = stats
        self.items, self.threshold, self.read, self.passed = items, threshold, 0, 0
        self.parts = [parts_of(t) for _, t in items]
        sections = [(k, terms[at : at + SECTION]) for k, (_, text) in enumerate(items) for terms in [terms_of(text)] for at in range(0, len(terms), SECTION)]
        self.owner = [k for k, _ in sections]
        self.size = max(1, -(-len(sections) // BLOCKS))
        self.ids: dict[str, int] = {}
        self.sections: list[list[int]] = []  # of each term, ascending
        self.gains: list[list[float]] = []
        for s, (_, terms) in enumerate(sections):
            gains = {}
            for t, tf in Counter(terms).items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                gains[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(terms) / mean))
            total = sum(gains.values())
            for t, g in gains.items():
                k = self.ids.setdefault(t, len(self.ids))
                if k == len(self.sections):
                    self.sections.append([])
                    self.gains.append([])
                self.sections[k].append(s)
                self.gains[k].append(g / total)
        self.top = [max(g) for g in self.gains]
        self.blocks = np.zeros((len(self.top), BLOCKS), np.float32)
        self.ranges = np.zeros((len(self.top), RANGES), np.float32)
        for k, (own, gains) in enumerate(zip(self.sections, self.gains, strict=True)):
            for s, g in zip(own, gains, strict=True):
                b = s // self.size
                self.blocks[k, b] = max(self.blocks[k, b], g)
        if len(self.top):
            self.ranges = self.blocks.reshape(-1, RANGES, BLOCKS // RANGES).max(2)

    def _wand(self, own: list[int]) -> Iterator[tuple[int, float]]:
        """(section, score) at the threshold for a query of different terms: block-max WAND."""
        sections, gains, top, size, need = self.sections, self.gains, self.top, self.size, self.threshold - SPARE
        maxima = self.blocks[own]
        live = np.flatnonzero(maxima.sum(0) >= need).tolist()
        if not live:
            self.passed += sum(len(sections[t]) for t in own)
            return
        maxima = dict(zip(own, maxima[:, live].tolist(), strict=True))
        cursors = []  # section, term, place in its postings
        for t in own:
            place = bisect.bisect_left(sections[t], live[0] * size)
            self.passed += place
            if place < len(sections[t]):
                cursors.append([sections[t][place], t, place])
        while cursors:
            cursors.sort()
            bound, p = 0.0, -1
            for k, c in enumerate(cursors):
                bound += top[c[1]]
                if bound >= need:
                    p = k
                    break
            if p < 0:
                break
            pivot, n = cursors[p][0], p + 1
            while n < len(cursors) and cursors[n][0] == pivot:
                n += 1
            block = pivot // size
            k = bisect.bisect_left(live, block)
            if k == len(live):
                break
            if live[k] > block:
                to, n = live[k] * size, len(cursors)
            elif sum(maxima[c[1]][k] for c in cursors[:n]) < need:
                to = (block + 1) * size if n == len(cursors) else min((block + 1) * size, cursors[n][0])
            elif cursors[0][0] == pivot:
                score = sum(gains[c[1]][c[2]] for c in cursors[:n])
                self.read += n
                if score >= self.threshold:
                    yield pivot, score
                to = pivot + 1
            else:
                to = pivot
            done = False
            for c in cursors[:n]:
                if c[0] < to:
                    at = sections[c[1]]
                    place = bisect.bisect_left(at, to, c[2])
                    self.passed += place - c[2] - (c[0] == pivot and to == pivot + 1)
                    if place < len(at):
                        c[0], c[2] = at[place], place
                    else:
                        c[0], done = -1, True
            if done:
                cursors = [c for c in cursors if c[0] >= 0]
        self.passed += sum(len(sections[t]) - at for _, t, at in cursors)

    def _windows(self, terms: list[str]) -> Iterator[tuple[int, int, float]]:
        """(window, section, score) at the threshold."""
        known = self.ids.get
        ids = np.array([known(t, -1) for t in terms], np.int64)
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return
        width = len(self.ids)
        pairs = np.unique(at // SECTION * width + ids[at])
        span, term = pairs // width, pairs % width
        spans, first = np.unique(span, return_index=True)
        sums = np.zeros((-(-len(terms) // SECTION) + 1, RANGES), np.float32)
        sums[spans] = np.add.reduceat(self.ranges[term], first, axis=0)
        bounds = sums[:-1] + sums[1:]
        for w in np.flatnonzero((bounds >= self.threshold - SPARE).any(1)).tolist():
            own = np.unique(term[slice(*np.searchsorted(span, (w, w + 2)))])  # a term of both spans counts once
            for s, g in self._wand(own.tolist()):
                yield w, s, g

    def search(self, text: str | None) -> list[dict]:
        """The items that a document holds: all retrieved whose question and answer overlap."""
        terms = terms_of(text)
        hits: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for w, s, g in self._windows(terms):
            hits[self.owner[s]].append((w, g))
        out = []
        for k, found in sorted(hits.items()):
            reach = sum(map(len, self.parts[k]))
            spans: list[list[int]] = []
            for w in sorted({w for w, _ in found}):
                lo, hi = max(0, w * SECTION - reach), (w + 2) * SECTION + reach
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            near = [terms[lo:hi] for lo, hi in spans]
            question, answer = max(((overlap(self.parts[k][0], x), overlap(self.parts[k][1], x)) for x in near), key=min)
            if min(question, answer) >= OVERLAP:
                out.append({"item_id": self.items[k][0], "score": max(g for _, g in found), "question_overlap": question, "answer_overlap": answer, "first_word": min(w for w, _ in found) * SECTION, "windows": len({w for w, _ in found})})
        return out


def too_short(items: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, text of the items that have words, but fewer than SHORTEST."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([0 < len(terms_of(t)) < SHORTEST for t in batch.column(1).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def indexes(items: DataFrame, *, item_id: str = "item_id", text: str = "text", threshold: float = THRESHOLD) -> Iterator[Index]:
    """Indexes of shards of the items long enough. BM25's counts (sections, mean length, document frequencies) are of all of these."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where(F.col("t").isNotNull()).orderBy("i", "t")
    df: Counter[str] = Counter()
    n = words = 0
    for r in rows.toLocalIterator():
        terms = terms_of(r.t)
        if len(terms) < SHORTEST:
            continue
        for at in range(0, len(terms), SECTION):
            df.update(set(terms[at : at + SECTION]))
            n += 1
        words += len(terms)
    stats, held, size = (n, words / max(n, 1), df), [], 0
    for r in rows.toLocalIterator():
        length = len(terms_of(r.t))
        if length < SHORTEST:
            continue
        sections = -(-length // SECTION)
        if held and size + sections > SHARD:
            yield Index(held, stats=stats, threshold=threshold)
            held, size = [], 0
        held, size = [*held, (r.i, r.t)], size + sections
    if held:
        yield Index(held, stats=stats, threshold=threshold)


class Shards:
    """Broadcast index shards of which a worker holds HELD at a time."""

    def __init__(self, spark: SparkSession, made: Iterator[Index]):
        self.sent = [spark.sparkContext.broadcast(index) for index in made]

    def search(self, texts: list[str | None], *, back: bool) -> list[list[dict]]:
        """The hits of each text, from all shards; every second call goes backwards, so that the shards held serve first."""
        hits: list[list[dict]] = [[] for _ in texts]
        order = self.sent[::-1] if back else self.sent
        for k, sent in enumerate(order):
            index = sent.value
            for out, text in zip(hits, texts, strict=True):
                out += index.search(text)
            if k < len(order) - HELD:  # the last ones come first next time
                vars(sent).pop("_value", None)
        return hits


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the columns of FOUND: a row for each document and each item it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    shards = Shards(spark, indexes(items, item_id=item_id, text=item_text, threshold=threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            found = shards.search(batch.column(1).to_pylist(), back=bool(k % 2))
            rows = [{"doc_id": one} | hit for one, hits in zip(batch.column(0).to_pylist(), found, strict=True) for hit in hits]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return source.mapInArrow(run, f"doc_id long, {FOUND}")


arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64()), ("windows", pa.int64())])


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    at, columns = docs.columns.index(text), docs.columns
    shards = Shards(spark, indexes(items, item_id=item_id, text=item_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            found = shards.search(batch.column(at).to_pylist(), back=bool(k % 2))
            yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
