"""Toxicity by a classifier chain of linear models over words.

Categories are predicted one after another (first low quality, then toxic); each later model takes the earlier
categories' log-odds as further features, and is trained with their out-of-fold predictions, so it sees at training the same kind of
values as at scoring. The models are fitted on a bounded sample of labelled documents (``SAMPLE`` rows of least id hash,
whole texts, ``SAMPLE_BYTES`` of distinct words at most); all else reads all documents. Features are the presence of words, ASCII case folded and without outer
punctuation, known by 64-bit codes; a category's words are those whose chi-square in the sample is over ``CHI2``, at most
``WORDS``, without words that only a group of near copies holds (unless there are no others). The
threshold of the last is the one of the greatest F1 of its out-of-fold predictions. The models, a few hundred numbers, travel with the tasks; scoring is one pass without a shuffle.

Defined cases: null or empty text has no words and gets the models' base rate; repeated rows are scored alike; null labels or
labels of unknown documents are not used; labels of any whole-number type; with fewer than two classes in the sample a model gives the sample's rate; an empty
table gives an empty result; extra columns are not carried by ``score``, and all are by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .common import blank, give_back_memory, text_slices

CATEGORIES = ("low_quality", "toxic")
SAMPLE, FOLDS, CHI2, WORDS, ALIKE, RIDGE = 8000, 5, 20.0, 200, 0.5, 0.2
#: Bytes of the sample's distinct words (eight a word) at most; documents beyond, in the sample's order, are not fitted on.
SAMPLE_BYTES = 64 << 20
PUNCTUATION = ".,;:!?\"'()[]{}%&$#*|"


def word_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct word codes of each text."""
    flat, offsets = W.split(texts, lower=True)
    codes = W.codes(pc.ascii_trim(flat, PUNCTUATION))
    for a, b in zip(offsets, offsets[1:]):
        yield np.unique(codes[a:b])


@dataclass
class Linear:
    """A linear model over word presence and earlier categories' log-odds."""

    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    #: probability from which the category is called
    threshold: float = 0.5

    def matrix(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(self.codes)), np.float32)
        for i, s in enumerate(sets):
            if len(self.codes):
                at = np.searchsorted(self.codes, s)
                at[at == len(self.codes)] = 0
                x[i, at[self.codes[at] == s]] = 1
        return x

    def log_odds(self, sets: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        return self.matrix(sets) @ self.weights + before @ self.earlier + self.bias


def chosen_words(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Codes of the words most associated with y, sorted."""
    if not len(sets):
        return np.zeros(0, np.uint64)
    codes, at = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.repeat(y, [len(s) for s in sets])
    have = np.bincount(at, minlength=len(codes)).astype(float)
    with_y = np.bincount(at, label, minlength=len(codes))
    n, positive = len(y), y.sum()
    expected = have * positive / n
    spread = expected * (1 - positive / n) * (1 - have / n)
    chi2 = np.where((spread > 0) & (have >= 5), (with_y - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    best = np.argsort(-chi2, kind="stable")[:WORDS]
    best = best[chi2[best] > CHI2]
    # a word that stands for one group of near copies says nothing about other documents; how alike any texts are is allowed for
    bound = ALIKE + (1 - ALIKE) * _alike(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[order], np.arange(len(codes) + 1))
    good = [k for k in best if _alike([sets[i] for i in owner[order[edge[k] : edge[k + 1]]] if y[i] == (with_y[k] > expected[k])]) <= bound]
    return np.sort(codes[good or best])  # such words are used only when there are no others


def _alike(sets: list[np.ndarray], most: int = 12) -> float:
    """Mean Jaccard similarity of neighbours among some of the sets."""
    some = [sets[int(i)] for i in np.linspace(0, len(sets) - 1, min(most, len(sets)))]
    both = [len(np.intersect1d(a, b, assume_unique=True)) / max(1, len(np.union1d(a, b))) for i, a in enumerate(some) for b in some[:i]]
    return float(np.mean(both)) if both else 1.0


def fit_linear(sets: list[np.ndarray], before: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = RIDGE) -> Linear:
    """Ridge logistic regression by Newton's method."""
    model = Linear(earlier=np.zeros(before.shape[1]))
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    model.bias = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return model
    model.codes = chosen_words(sets, y)
    x = np.hstack([model.matrix(sets).astype(float), before, np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = model.bias
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    k = len(model.codes)
    model.weights, model.earlier, model.bias = w[:k], w[k:-1], float(w[-1])
    return model


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """One model a column of labels; earlier columns enter later models by out-of-fold log-odds."""
    n, k = labels.shape
    before, chain = np.zeros((n, 0)), []
    for c in range(k):
        y = labels[:, c]
        chain.append(fit_linear(sets, before, y))
        held = np.zeros(n)
        for f in range(folds):
            test = np.arange(n) % folds == f
            if test.any():
                train = [s for s, t in zip(sets, test) if not t]
                model = fit_linear(train, before[~test], y[~test])
                held[test] = model.log_odds([s for s, t in zip(sets, test) if t], before[test])
        chain[-1].threshold = best_threshold(1 / (1 + np.exp(-held)), y)
        before = np.hstack([before, held[:, None]])
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the greatest F1 of out-of-fold probabilities (the highest on ties); a half if a class is missing."""
    if len(np.unique(y)) < 2:
        return 0.5
    order = np.argsort(-p, kind="stable")
    values, at = p[order], np.arange(1, len(p) + 1)
    f1 = 2 * np.cumsum(y[order]) / (at + y.sum())
    last = np.append(values[1:] != values[:-1], True)  # equal probabilities fall on one side
    return float(values[np.argmax(np.where(last, f1, -1))])


def chain_probabilities(chain: list[Linear], sets: list[np.ndarray]) -> np.ndarray:
    odds = np.zeros((len(sets), 0))
    for model in chain:
        odds = np.hstack([odds, model.log_odds(sets, odds)[:, None]])
    return 1 / (1 + np.exp(-odds))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Linear]:
    """The chain, from ``sample`` labelled documents at most."""
    known = labels.select(F.col("doc_id").alias("of"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    # an id labelled more than once counts as what any of its labels says, so the choice does not depend on their order
    known = known.dropna().groupBy("of").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(5), "of")
    taken = known.orderBy(order, "of").limit(sample)
    # the sample is bounded, so its ids are broadcast and only its words come to the driver
    rows = docs.select("doc_id", blank("text").alias("text")).join(F.broadcast(taken), F.col("doc_id") == F.col("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            packed = [s.tobytes() for s in word_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), batch.column("toxic"), pa.array(packed, pa.binary())],
                ["doc_id", "quality", "toxic", "codes"],
            )

    got = rows.select("doc_id", "quality", "toxic", "text").mapInArrow(run, "doc_id long, quality int, toxic int, codes binary")
    # of several texts with one id one is taken; a running sum over the sample alone bounds the bytes
    got = got.groupBy("doc_id").agg(F.min(F.struct("codes", "quality", "toxic")).alias("one")).select("doc_id", "one.*")
    so_far = F.sum(F.octet_length("codes").cast("long")).over(Window.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id"))
    got = got.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_BYTES).drop("so_far").toArrow().sort_by("doc_id")
    _, first = np.unique(np.array([b.as_py() for b in got["codes"]], object), return_index=True) if len(got) else (0, [])
    got = got.take(np.sort(np.array(first, np.int64)))  # equal sets count once
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in got["codes"]]
    y = np.stack([1.0 - got["quality"].to_numpy(), got["toxic"].to_numpy().astype(float)], axis=1)
    chain = fit_chain(sets, y)
    del got, sets
    give_back_memory()  # the driver's as well
    return chain


def _with_probabilities(chain: list[Linear], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in text_slices(batches, "text"):
        yield batch, chain_probabilities(chain, list(word_sets(batch.column("text"))))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic."""
    chain = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _with_probabilities(chain, batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p[:, c]) for c in range(len(CATEGORIES))]], ["doc_id", *[f"p_{c}" for c in CATEGORIES]])

    of = docs.select("doc_id", blank("text").alias("text"))
    out = of.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"p_{c} double" for c in CATEGORIES))
    return out.withColumn("toxic", F.col("p_toxic") >= chain[-1].threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the documents the chain calls toxic; all columns stay, whatever their names."""
    chain = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _with_probabilities(chain, batches):
            yield batch.filter(pa.array(p[:, -1] < chain[-1].threshold))

    return docs.mapInArrow(run, docs.schema)
