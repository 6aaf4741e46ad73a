"""Toxicity by a counterfactually regularised linear classifier.

Features are a text's distinct words and their prefixes. Those that mark toxic documents beyond
chance (a G test over the sample) enter a logistic regression. Sentences of the sample that name a
group are copied with the group's term swapped for another, and the squared change of the score is
penalised, so that a mention alone moves no score.

The fit uses at most SAMPLE_ROWS labelled documents, those with the least seeded hash of their id, one
row an id;
counts of features and their G test stay in Spark, and only chosen features reach the driver, at most
MAX_FEATURES. Of the sentences to swap, the MAX_SWAPS with the least seeded hash over the whole sample
are used. Every document is scored over its whole text.

Defined results: a null or empty text has the score of no features; a null id is never trained on
and not held out; repeated labels of an id count as their maximum, of rows that repeat an id the text with
the least hash is learnt from; without labels of both classes
every score is the share of toxic ones (0 if there are none); repeated rows are answered row by
row; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocks, texts_of

#: Bound of the sample that the classifier is fitted on.
SAMPLE_ROWS = 20_000
SEED = 7
MAX_FEATURES = 4096
#: Sentences with a group's term that the whole sample gives at most.
MAX_SWAPS = 100_000
MIN_DOCS = 3
MIN_G = 13.0
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
RIDGE = 5e-5
COUNTERFACTUAL = 5.0
HELD_OUT = 2

#: Terms for groups of people; a term is swapped within its row only.
GROUPS = (
    "women men girls boys woman man girl boy".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "black white asian latino african european".split(),
    "gay lesbian bisexual straight transgender queer".split(),
    "immigrants refugees migrants foreigners natives".split(),
    "disabled deaf blind autistic".split(),
    "old young elderly teenage".split(),
    "mexican chinese indian american german french polish turkish".split(),
)
SWAP = {t: g[(i + 1) % len(g)] for g in GROUPS for i, t in enumerate(g)}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def text_features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


@dataclass
class Model:
    """Weights by feature and the bias; `cache` keeps the weighted features of words seen."""

    names: dict[str, int]
    weights: np.ndarray
    bias: float
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    KEPT_WORDS = 400_000

    def active(self, text: str) -> set[int]:
        get, found = self.cache.get, set()
        for word in set(_WORD.findall(text.lower())):
            hit = get(word)
            if hit is None:
                if len(self.cache) >= self.KEPT_WORDS:
                    self.cache.clear()
                hit = self.cache[word] = tuple(self.names[f] for f in word_features(word) if f in self.names)
            if hit:
                found.update(hit)
        return found

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[i] for i in sorted(self.active(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[list[int], list[int]]], n: int, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on index lists, with a ridge and the counterfactual penalty, by Adam."""
    size = np.array([len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    plus = np.array([(i, j) for i, (a, _) in enumerate(swaps) for j in a], np.int64).reshape(-1, 2)
    minus = np.array([(i, j) for i, (_, b) in enumerate(swaps) for j in b], np.int64).reshape(-1, 2)
    w = np.zeros(n + 1)
    w[n] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = w[n] + np.bincount(owner, w[flat], len(rows))
        off = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        g = np.zeros(n + 1)
        g[:n] = np.bincount(flat, off[owner], n) / len(rows) + RIDGE * w[:n]
        g[n] = off.mean()
        if swaps:
            change = np.bincount(plus[:, 0], w[plus[:, 1]], len(swaps)) - np.bincount(minus[:, 0], w[minus[:, 1]], len(swaps))
            pull = 2 * COUNTERFACTUAL / len(swaps)
            g[:n] += pull * (np.bincount(plus[:, 1], change[plus[:, 0]], n) - np.bincount(minus[:, 1], change[minus[:, 0]], n))
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:n], float(w[n])


def swapped(sentence: str) -> str | None:
    """The sentence with every group term replaced, or None if it names no group."""
    words = _WORD.findall(sentence.lower())
    if not any(w in SWAP for w in words):
        return None
    return " ".join(SWAP.get(w, w) for w in words)


def _feature_counts(sample: DataFrame, toxic: int) -> DataFrame:
    """Documents of a class by feature, summed up in each partition first."""

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in blocks(batches, "text"):
            for text in texts_of(batch, "text"):
                counts.update(text_features(text))
            if len(counts) > 1_000_000:
                yield pa.RecordBatch.from_pydict({"feature": list(counts), "n": pa.array(counts.values(), pa.int64())})
                counts.clear()
        if counts:
            yield pa.RecordBatch.from_pydict({"feature": list(counts), "n": pa.array(counts.values(), pa.int64())})

    counted = sample.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "feature string, n long")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"))


def g_statistic(n1: np.ndarray, n0: np.ndarray, total1: int, total0: int) -> np.ndarray:
    """Likelihood ratio of a feature's documents being spread over the classes by chance."""
    n = n1 + n0
    share = total1 / (total1 + total0)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(n1 > 0, n1 * np.log(n1 / (n * share)), 0)
        b = np.where(n0 > 0, n0 * np.log(n0 / (n * (1 - share))), 0)
    return 2 * (a + b)


def _marks(sample: DataFrame, one: int, none: int) -> DataFrame:
    """Rows (feature, g): all features that mark toxic documents beyond chance."""
    toxic = _feature_counts(sample, 1).where(F.col("n") >= MIN_DOCS)
    clean = _feature_counts(sample, 0).withColumnRenamed("n", "n0")
    both = toxic.join(clean, "feature", "left").select("feature", F.col("n").cast("double"), F.coalesce("n0", F.lit(0)).cast("double").alias("n0"))

    def run(batches):
        for batch in batches:
            n1, n0 = (batch.column(k).to_numpy() for k in (1, 2))
            g = g_statistic(n1, n0, one, none)
            marks = pa.array((g >= MIN_G) & (n1 * none > n0 * one))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g)], names=["feature", "g"]).filter(marks)

    return both.mapInArrow(run, "feature string, g double")


def _swaps(sample: DataFrame, model: Model, limit: int) -> DataFrame:
    """Features that a sentence loses and gains by its swap, of the `limit` sentences with the least hash."""
    salt = SEED.to_bytes(8, "big")

    def run(batches):
        for batch in blocks(batches, "text"):
            at, plus, minus = [], [], []
            for text in texts_of(batch, "text"):
                own = None
                for i, sentence in enumerate(_SENTENCE.split(text)):
                    if (other := swapped(sentence)) is not None:
                        own = own or blake2b(text.encode(), digest_size=16, salt=salt).digest()
                        at.append(int.from_bytes(blake2b(own + i.to_bytes(8, "big"), digest_size=8).digest(), "big", signed=True))
                        x, y = model.active(sentence), model.active(other)
                        plus.append(sorted(x - y))
                        minus.append(sorted(y - x))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(plus, ints), pa.array(minus, ints)], names=["at", "plus", "minus"])

    return sample.select("text").mapInArrow(run, "at long, plus array<int>, minus array<int>").orderBy("at", "plus", "minus").limit(limit).select("plus", "minus")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(SAMPLE_ROWS)
    parts = 2 * spark.sparkContext.defaultParallelism
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by SAMPLE_ROWS
    once = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = scratch.put(once.select("toxic", "text").repartition(parts), "sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    one, none = totals.get(1, 0), totals.get(0, 0)
    if not one or not none:
        share = one / (one + none) if one + none else 0.0
        return Model({}, np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    chosen_features = _marks(sample, one, none).orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect()
    kept = sorted({r["feature"] for r in chosen_features} | {f for t in SWAP for f in word_features(t)})
    model = Model({f: i for i, f in enumerate(kept)}, np.zeros(len(kept)), 0.0)

    def vectors(batches):
        for batch in blocks(batches, "text"):
            rows = [sorted(model.active(text)) for text in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "row"])

    # bounded: SAMPLE_ROWS documents, of each only the chosen features
    found = sample.mapInArrow(vectors, "toxic int, row array<int>").collect()
    found.sort(key=lambda r: (r["toxic"], r["row"]))
    swaps = [(list(r["plus"]), list(r["minus"])) for r in _swaps(sample, model, MAX_SWAPS).collect()]
    labels_ = np.array([r["toxic"] for r in found], float)
    model.weights, model.bias = fit([np.array(r["row"], np.int64) for r in found], labels_, sorted(swaps), len(kept))
    model.cache = {}
    scratch.drop(sample)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Rows doc_id, held_out, score and predicted."""
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches):
        for batch in blocks(batches, "text"):
            scores = [model.score(t) for t in texts_of(batch, "text")]
            arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    return score_documents(docs, train(spark, docs, labels, Scratch(spark, "toxicity")))
