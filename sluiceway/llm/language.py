"""Language identification by sparse multinomial logistic regression.

Texts are lower-cased and every run of characters that are no letters becomes one blank; all character
n-grams of N_GRAMS lengths are hashed into BUCKETS features, weighted by TF-IDF (logarithmic counts) and
scaled to unit length. The weights are trained with follow-the-regularised-leader (per-coordinate rates) under
an elastic-net penalty, so that most weights of the features met in training are zero too; a temperature
fitted on held-back rows then calibrates the probabilities.

The model is fitted in one task of an executor on about PER_LANGUAGE different labelled texts of each language, or
an equal share of MOST where there are many languages; each language's texts are those of the least hashes, so a
text repeated however often is learned once, and a language of any size gets its share. Every text to predict is
read whole. Null texts, empty ones and texts without a letter are `und` with score 0; if nothing can be learned
(an empty table, no labels), every text is. Null labels and rows without an id are not learned from. Rows without
an id are predicted like any other; repeated rows are predicted alike and stay; ties go to the first language by
name; only the named columns are read, and extra ones pass through under their names.
"""

from __future__ import annotations

import functools
import pickle
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table

N_GRAMS, BUCKETS = (1, 2, 3), 1 << 15  # buckets are numbered in 16 bits

#: About so many labelled texts the model is fitted on: of each language, and in all.
PER_LANGUAGE, MOST = 1_500, 12_000

#: L1 was compared on a split of training rows: at 0.1 four fifths of the weights met in training are zero, at the accuracy of 0.002.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 0.1, 1e-4, 3

#: Counts of up to so many languages are broadcast, more are joined by shuffle.
BROADCAST_LANGUAGES = 50_000

UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.frombuffer(bytes(chr(k).isalpha() for k in range(sys.maxunicode + 1)), np.bool_)


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, a blank (32) for every run of others than letters, one at each end; empty without letters."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _letters()[x]
    if not ok.any():
        return x[:0]
    x = np.where(ok, x, np.uint32(32))
    ok[1:] |= ok[:-1]  # a blank stays behind a letter only
    x = x[ok] if x[0] != 32 else x[ok]
    blank = np.array([32], np.uint32)
    return np.concatenate((blank, x) if x[-1] == 32 else (blank, x, blank))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and logarithmic counts of the text's n-grams; None without letters."""
    x = code_points(text or "")
    if not len(x):
        return None
    h, parts = np.zeros(len(x), np.uint32), []
    for n in range(1, max(N_GRAMS) + 1):
        h = (h[: len(x) - n + 1] * np.uint32(0x01000193)) ^ (x[n - 1 :] + np.uint32(n << 24))
        if n in N_GRAMS:
            parts.append((h * np.uint32(0x9E3779B1)) >> np.uint32(17))
    counts = np.bincount(np.concatenate(parts), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


class Model:
    """names, weights (BUCKETS x names) over idf-weighted unit vectors, biases, temperature."""

    def __init__(self, names: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.names, self.idf, self.weights, self.bias, self.temperature = names, idf, weights, bias, 1.0

    def logits(self, f: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, x = f
        x = x * self.idf[at]
        return x @ self.weights[at] / max(1e-12, float(np.sqrt(x @ x))) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        f = features(text)
        if f is None:
            return UNKNOWN, 0.0
        z = self.logits(f) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.names[k], float(p[k] / p.sum())


def fit(rows: Iterable[tuple[str, str]]) -> Model | None:
    """The model from (text, language) rows: every fifth is held back for the temperature.

    Texts are turned to features as they come and not kept; features take six bytes each.
    """
    ats, xs, labels = [], [], []
    for text, label in rows:
        f = features(text)
        if f is not None:
            ats.append(f[0].astype(np.uint16))
            xs.append(f[1].astype(np.float32))
            labels.append(label)
    names = sorted(set(labels))
    if not names:
        return None
    cuts = np.cumsum([len(a) for a in ats])
    ats, xs = np.concatenate(ats), np.concatenate(xs)
    data = [((ats[hi - n : hi], xs[hi - n : hi]), y) for hi, n, y in zip(cuts.tolist(), np.diff(cuts, prepend=0).tolist(), labels, strict=True)]
    own = [x for k, x in enumerate(data) if k % 5] or data
    back = [x for k, x in enumerate(data) if not k % 5]
    df = np.zeros(BUCKETS)
    for (at, _), _ in own:
        df[at] += 1
    idf = np.log((1 + len(own)) / (1 + df)) + 1
    z, n = np.zeros((BUCKETS + 1, len(names))), np.zeros((BUCKETS + 1, len(names)))
    order = np.random.default_rng(0)
    model = Model(names, idf, np.zeros((BUCKETS, len(names))), np.zeros(len(names)))

    def leader(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(PASSES):
        for k in order.permutation(len(own)):
            (at, x), y = own[k]
            x = x * idf[at]
            x = np.append(x / np.sqrt(x @ x), 1.0)
            at = np.append(at.astype(np.int64), BUCKETS)  # the bias
            w = leader(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[names.index(y)] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(z, n)
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
    logits = np.array([model.logits(f) for f, _ in back])
    truth = np.array([names.index(y) for _, y in back])
    if len(back):
        losses = []
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        for t in grid:
            s = logits / t
            s = s - s.max(1, keepdims=True)
            losses.append(float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean()))
        model.temperature = float(grid[int(np.argmin(losses))])
    return model


def sampling_share(texts: Column, languages: Column | int, *, per_language: int = PER_LANGUAGE, most: int = MOST) -> Column:
    """The share of a language's texts that is learned from; above zero for any count of texts."""
    return F.least(F.lit(1.0), F.least(F.lit(float(per_language)), F.lit(float(most)) / languages) / texts)


def sample(labelled: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most: int = MOST) -> DataFrame | None:
    """text, lang: the labelled texts to learn from, each once; None if there are none."""
    rows = labelled.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    key = F.xxhash64("text")
    counts = cut(rows.groupBy(F.col("lang").alias("l")).agg(F.approx_count_distinct(key).alias("n")))
    if not (languages := counts.count()):
        return None
    counts = counts.select("l", sampling_share(F.greatest(F.col("n"), F.lit(1)), languages, per_language=per_language, most=most).alias("share"))
    # The place of a text's hash among all hashes, from 0 to 1.
    place = (key.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    picked = rows.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, F.col("lang") == F.col("l"))
    return picked.where(place <= F.col("share")).select("text", "lang").distinct()


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most: int = MOST) -> bytes | None:
    """The pickled model; it is all that the driver sees."""
    small_batches(labelled.sparkSession)
    picked = sample(labelled, text=text, lang=lang, per_language=per_language, most=most)
    if picked is None:
        return None
    order = F.xxhash64("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_pylist([{"model": pickle.dumps(fit(rows))}], schema=pa.schema([("model", pa.binary())]))

    made = picked.repartition(1).sortWithinPartitions(order, "text", "lang").mapInArrow(run, "model binary").first()
    return None if made is None else bytes(made.model)


def predicted(rows: DataFrame, model: bytes | None, *, text: str) -> DataFrame:
    """The rows with lang_pred and score behind their columns."""
    spark = rows.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model if model is not None else pickle.dumps(None))
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(sent.value)
        for batch in batches:
            found = [held.predict(t) if held else (UNKNOWN, 0.0) for t in batch.column(at).to_pylist()]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score"])

    schema = rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fitted(docs: DataFrame) -> bytes | None:
    """A model learned from the documents that are not held out; those without an id are left out as well."""
    return train(docs.where(~held_out(F.col("doc_id"))))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predicted(docs.select("doc_id", "text"), fitted(docs), text="text")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


#: A document is rejected if it has no letter, or its language is less likely than this.
LEAST = 0.5


def recognised(docs: DataFrame, *, least: float = LEAST) -> DataFrame:
    """The documents whose language is recognised, with their own columns."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    found = predicted(rows, fitted(docs), text=f"c{names.index('text')}")
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


QUERIES = {"op5_language": op5_language}
