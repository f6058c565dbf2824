"""Toxicity by maximum-scoring segments.

Every word has a log-odds between toxic and clean texts, from its rate among the words of either kind; a text
counts a word by the square root of its occurrences there, as repeats say less than new texts. The rates are
smoothed with a Dirichlet prior that the word's prefixes supply, the longer over the shorter (the shortest
over the whole vocabulary), so that unseen words of a known family score too. Less a drift, common words
score below zero; one scan in linear time (Ruzzo and Tompa) then finds all maximal segments of positive total.
Repeats of a word within a segment are no further evidence: a segment counts for the greatest total of a
stretch of it in which a word speaks once.

The greatest scores of clean texts follow an extreme-value law whose location grows with the logarithm of a
text's length; it is fitted on clean texts that the log-odds did not see. Segments rarer than SIGNIFICANT under
it are the toxic passages, each judged by itself, whatever other passages hold. A text as a whole is judged by
the sum statistics of that law (Karlin and Altschul): its surprise is the greatest -log chance of the r best
segments together, over all r, a word's evidence counting in the best of them only. Logistic calibration on the
held-back texts turns it into a probability.

The model is fitted on at most MOST labelled rows of each label, taken in the order of a hash (of the id, or of
the text where there is none), in one task that holds their texts; rows to score go through whole, in linear
time but for the n log n of words repeated within one segment. Null and empty texts have no segment and get the
score of a text without any; null labels and labels without an id are not learned from; an id with both labels
is toxic; without labelled rows of both kinds every score is 0; ties among segments go to the earlier; equal
texts get equal scores, and repeated rows and null ids stay; empty tables give no rows; clashing or extra
columns do no harm, as only the named columns are read.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: Labelled rows of each label that the model may be fitted on.
MOST = 3_000

#: Drift, prior strength, prefixes and the way of counting were compared by cross-validation within the training rows.
PREFIXES, KAPPA, DRIFT, SIGNIFICANT = (3, 4, 5, 6), 3.0, 2.0, 1e-3

#: Word scores that a worker keeps.
KEPT = 300_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, total) of a sequence, in order; linear in its length."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    runs = [(int(a[0]), int(a[-1]) + 1) for a in np.split(at, breaks)]
    # first, end, sum before, sum after, and the nearest earlier segment that starts lower: links are passed once each.
    held: list[tuple[int, int, float, float, int]] = []
    for lo, hi in runs:
        first, before, after, k = lo, float(sums[lo]), float(sums[hi]), len(held) - 1
        while True:
            while k >= 0 and held[k][2] >= before:
                k = held[k][4]
            if k < 0 or held[k][3] >= after:
                held.append((first, hi, before, after, k))
                break
            first, _, before, _, link = held[k]
            del held[k:]
            k = link
    return [(a, b, y - x) for a, b, x, y, _ in held]


def evidence(scores: np.ndarray, found: list[str]) -> float:
    """The greatest total of a stretch in which each word's positive score counts once; n log n steps."""
    at = np.flatnonzero(scores > 0).tolist()
    if len({found[k] for k in at}) == len(at):
        return max((total for *_, total in segments(scores)), default=0.0)
    below = np.cumsum(np.minimum(scores, 0.0)).tolist()
    # A tree of maxima over the starts of stretches that end at the word in turn, less what is below zero before them.
    size = 1 << (len(at) - 1).bit_length()
    top, added, last, best = [-math.inf] * (2 * size), [0.0] * (2 * size), {}, 0.0
    for k, i in enumerate(at):
        top[size + k] = -below[i]
        s, lo, hi = float(scores[i]), size + last.get(found[i], -1) + 1, size + k + 1
        last[found[i]] = k
        ends = (lo, hi - 1)
        while lo < hi:
            if lo & 1:
                top[lo] += s
                added[lo] += s
                lo += 1
            if hi & 1:
                hi -= 1
                top[hi] += s
                added[hi] += s
            lo, hi = lo >> 1, hi >> 1
        for p in ends:
            while p > 1:
                p >>= 1
                top[p] = max(top[2 * p], top[2 * p + 1]) + added[p]
        best = max(best, top[1] + below[i])
    return best


class Odds:
    """Log-odds of words, from damped word counts in toxic and clean texts."""

    def __init__(self, toxic: Iterable[str], clean: Iterable[str]):
        levels: list[dict[str, list[float]]] = [{} for _ in range(len(PREFIXES) + 1)]
        sizes = [0.0, 0.0]
        for k, texts in enumerate((clean, toxic)):
            for text in texts:
                for w, n in Counter(words(text)).items():
                    sizes[k] += (n := math.sqrt(n))
                    for level, m in enumerate((*PREFIXES, None)):
                        levels[level].setdefault(w[:m], [0.0, 0.0])[k] += n
        # Counts of either kind as in a body of text of the smaller one's size.
        least = min(sizes)
        self.weights = (least / max(sizes[0], 1e-9), least / max(sizes[1], 1e-9))
        # What scores like its prefix needs no entry.
        self.levels = [{w: tuple(c) for w, c in x.items() if c[1] or c[0] > 1} for x in levels]

    def __call__(self, word: str) -> float:
        share, n = 0.5, None
        for level, n in zip(self.levels, (*PREFIXES, None), strict=True):
            if n is not None and len(word) < n:
                continue
            clean, toxic = level.get(word[:n], (0.0, 0.0))
            clean, toxic = clean * self.weights[0], toxic * self.weights[1]
            share = (toxic + KAPPA * share) / (clean + toxic + KAPPA)
        return math.log(share / (1 - share)) - DRIFT


class Model:
    def __init__(self, odds: Odds, scale: float, place: float, a: float, b: float):
        self.odds, self.scale, self.place, self.a, self.b = odds, scale, place, a, b
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def scores(self, found: list[str]) -> np.ndarray:
        got = list(map(self.known.get, found))
        if None in got:
            new = {w: self.odds(w) for w, s in zip(found, got, strict=True) if s is None}
            if len(self.known) < KEPT:
                self.known.update(new)
            got = [new[w] if s is None else s for w, s in zip(found, got, strict=True)]
        return np.array(got, np.float64)

    def excess(self, total: float, length: int) -> float:
        """A total on the law's own scale: its expected number in a clean text of so many words is exp(-excess)."""
        return (total - self.place) / self.scale - math.log(max(length, 1))

    def chance(self, total: float, length: int) -> float:
        """Chance that a clean text of so many words has a segment of this total."""
        return -math.expm1(-math.exp(min(700.0, -self.excess(total, length))))

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], float]:
        """Significant segments (first word, end, total, chance), and the surprise of the whole text."""
        found = words(text)
        scores, out, near, n = self.scores(found), [], [], len(found)
        for lo, hi, total in segments(scores):
            if self.excess(total, n) <= 0:
                continue  # its evidence is no greater
            total = evidence(scores[lo:hi], found[lo:hi])
            p = max(self.chance(total, n), 1e-300)
            if p < SIGNIFICANT:
                out.append((lo, hi, total, p))
            near.append((-total, lo, hi))
        spoken: set[str] = set()
        r, held, surprise = 0, 0.0, 0.0
        for total, lo, hi in sorted(near):
            own, part = found[lo:hi], scores[lo:hi]
            total = -total
            if spoken and any(w in spoken and x > 0 for w, x in zip(own, part, strict=True)):
                part = np.array([0.0 if w in spoken and x > 0 else x for w, x in zip(own, part, strict=True)])
                total = evidence(part, own)
            if (more := self.excess(total, n)) <= 0:
                continue
            spoken.update(w for w, x in zip(own, part, strict=True) if x > 0)
            r, held = r + 1, held + more
            surprise = max(surprise, held - (r - 1) * math.log(max(held, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
        return out, surprise

    def probability(self, surprise: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.a + self.b * math.log1p(surprise)))))


def fit(rows: list[tuple[str, int]], share: float) -> Model | None:
    """The model from (text, label) rows; share is that of toxic rows before they were bounded."""
    own = [[t for t, y in rows if y == label] for label in (0, 1)]
    half = [[t for k, t in enumerate(texts) if k % 4 != 3] for texts in own]
    back = [[t for k, t in enumerate(texts) if k % 4 == 3] for texts in own]
    if not all(half) or not all(back):
        return None
    model = Model(Odds(half[1], half[0]), 1.0, 0.0, 0.0, 1.0)
    tops, sizes = [], []
    for text in back[0]:
        found = words(text)
        scores = model.scores(found)
        tops.append(max((evidence(scores[lo:hi], found[lo:hi]) for lo, hi, _ in segments(scores)), default=0.0))
        sizes.append(math.log(max(1, len(found))))
    tops_, sizes_ = np.array(tops), np.array(sizes)
    model.scale = 1.0
    for _ in range(30):  # the scale is also the slope of the location, so both are fitted in turn, by quantiles
        low, high = np.quantile(tops_ - model.scale * sizes_, (0.5, 0.9))
        model.scale = max(0.3, (model.scale + float(high - low) / (math.log(math.log(2)) - math.log(-math.log(0.9)))) / 2)
    model.place = float(np.median(tops_ - model.scale * sizes_)) + model.scale * math.log(math.log(2))
    x = np.array([math.log1p(model.passages(t)[1]) for part in back for t in part])
    y = np.array([k for k, part in enumerate(back) for _ in part], np.float64)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    ab = np.zeros(2)
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-(ab[0] + ab[1] * x)))
        grad = np.array([(weight * (p - y)).sum(), (weight * (p - y) * x).sum()]) + 1e-3 * ab
        h = weight * p * (1 - p)
        step = np.linalg.solve(np.array([[h.sum(), (h * x).sum()], [(h * x).sum(), (h * x * x).sum()]]) + 1e-3 * np.eye(2), grad)
        ab -= step
        if np.abs(step).max() < 1e-9:
            break
    model.a, model.b = float(ab[0]), float(ab[1])
    model.odds = Odds(own[1], own[0])
    model.known = {}
    return model


def sampled(labels: DataFrame, *, doc_id: str = "doc_id", label: str = "label", most: int = MOST) -> tuple[DataFrame, float]:
    """doc_id, label of at most `most` labelled documents of each label, and the share of label 1 among all of them.

    Only ids and labels move; an id with two labels counts as toxic.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = cut(known)
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    return picks[0].unionAll(picks[1]), sizes.get(1, 0) / max(1, sum(sizes.values()))


def train(labelled: DataFrame, *, text: str = "text", label: str = "label", most: int = MOST, share: float | None = None) -> bytes | None:
    """The pickled model from at most `most` rows of each label (0, 1), fitted in one task of an executor.

    share: that of label 1 where the rows come from; by default theirs.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("int").alias("label")).where("text IS NOT NULL AND label IN (0, 1)")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    order = F.xxhash64("text")
    picks = [rows.where(F.col("label") == k).orderBy(order, "text").limit(most) for k in (0, 1)]
    share = counts[1] / (counts[0] + counts[1]) if share is None else share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        model = fit(held, share)
        yield pa.RecordBatch.from_pylist([{"model": pickle.dumps(model)}], schema=pa.schema([("model", pa.binary())]))

    made = picks[0].unionAll(picks[1]).repartition(1).sortWithinPartitions(order, "text", "label").mapInArrow(run, "model binary").first()
    return None if made is None else bytes(made.model)


PASSAGE = "array<struct<first_word: long, end_word: long, total: double, chance: double>>"


def score(docs: DataFrame, model: bytes | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, passages (all significant ones) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model if model is not None else pickle.dumps(None))
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("total", pa.float64()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(sent.value)
        for batch in batches:
            found = [held.passages(t) if held else ([], 0.0) for t in batch.column(1).to_pylist()]
            values = [held.probability(s) if held else 0.0 for _, s in found]
            spans = [[dict(zip(("first_word", "end_word", "total", "chance"), x, strict=True)) for x in p] for p, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"])

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, score double, passages {PASSAGE}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ids, share = sampled(labels.where(~held_out(F.col("doc_id"))), label="toxic")
    # At most 2 * MOST ids are broadcast; only their texts leave the scan.
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(ids.withColumnRenamed("doc_id", "id")), F.col("doc_id") == F.col("id")).select("text", "label"))
    model = train(rows, share=share)
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {"op4_toxicity": op4_toxicity}
