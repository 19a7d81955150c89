"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic texts and unlabelled ones.  Its risk
estimator is corrected by the class prior pi:

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

and where the second part turns negative the step ascends it instead, which
keeps the estimate from being fitted below zero.  Inputs are the presence of
words and word beginnings that mark toxic texts off from unlabelled ones.

Nulls and oddities: a null text is scored as an empty one, with the score of
the bias alone; repeated rows get equal scores; a null doc_id is held out;
without a toxic or any other text to learn from, every score is the prior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_ids, held_out, text_slices

WORD = re.compile(r"[^\W\d_]+")
#: Texts learnt from, at most: confirmed toxic ones, and unlabelled ones.
POSITIVE_BOUND, UNLABELLED_BOUND = 5_000, 20_000
VOCABULARY = 64
#: Standard errors by which a feature's share of toxic texts must exceed that of the others.
LEAST_Z = 3.0
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6, 7)
STEPS = 400


def marks(text: str | None) -> dict[str, float]:
    """The features of a text: its words, and word beginnings with a ^ before them.

    A feature's value is log(1 + its distinct words among each 100 of the text's).
    """
    words = set(WORD.findall((text or "").lower()))
    counts = Counter(words)
    for k in STEMS:
        counts.update("^" + w[:k] for w in words if len(w) >= k)
    scale = 100 / max(len(words), 50)
    values = {c: math.log1p(c * scale) for c in set(counts.values())}
    return {f: values[c] for f, c in counts.items()}


def distinct_stems(ranked: list[str]) -> tuple[str, ...]:
    """The features without those that extend, or begin, a better one."""
    chosen: list[str] = []
    for f in ranked:
        bare = f.removeprefix("^")
        if not any(bare.startswith(c.removeprefix("^")) or c.removeprefix("^").startswith(bare) for c in chosen):
            chosen.append(f)
    return tuple(chosen)


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        index = {w: float(x) for w, x in zip(self.words, self.weights, strict=True)}
        stems = {k: {f[1:]: x for f, x in index.items() if f[0] == "^" and len(f) == k + 1} for k in STEMS}
        logits = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            words = set(WORD.findall((text or "").lower()))
            counts = Counter(w for w in words if w in index)
            for k, known in stems.items():
                if known:
                    counts.update("^" + s for w in words if (s := w[:k]) in known)
            scale = 100 / max(len(words), 50)
            logits[i] += math.fsum(index[f] * math.log1p(c * scale) for f, c in counts.items())
        return sigmoid(logits)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_nnpu(values: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of a logistic model.

    values: a row for each text; positive[i]: whether text i is confirmed.
    """
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    width = values.shape[1]
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        f = b + values @ w
        s = sigmoid(f)
        soft_minus = np.logaddexp(0, f)  # loss of calling a text clean
        rest = soft_minus[~positive].sum() / n_u - prior * soft_minus[positive].sum() / n_p
        g = np.where(positive, -prior * s / n_p, s / n_u)  # slope of that rest
        g = g + np.where(positive, prior * (s - 1) / n_p, 0) if rest >= 0 else -g
        slope = np.append(values.T @ g + 1e-4 * w, g.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labels of the training folds and the texts of a bounded sample.

    The driver gets the chosen words and, for each sampled text, which of them
    it has: both bounded by the parameters above.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    row = known.agg(F.avg("toxic").alias("prior"), F.count("*").alias("n")).first()
    prior = min(0.9, max(0.001, row["prior"] or 0.001))
    toxic = bounded_ids(known.where("toxic = 1"), "doc_id", POSITIVE_BOUND)
    open_ids = bounded_ids(docs.where(~held_out(F.col("doc_id"))), "doc_id", UNLABELLED_BOUND, salt=1)
    picked = toxic.withColumn("p", F.lit(1)).unionByName(open_ids.withColumn("p", F.lit(0)))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = [sorted(marks(t).items()) for t in part["text"].to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.record_batch(
                [part["p"].take(pa.array(owner)), pa.array([f for x in found for f, _ in x], pa.string()), pa.array([v for x in found for _, v in x], pa.float64())],
                ["p", "word", "v"],
            )

    sizes = {r["p"]: r["count"] for r in sample.groupBy("p").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return Model((), np.zeros(0), float(np.log(prior / (1 - prior))))
    seen = sample.mapInArrow(words, "p int, word string, v double").groupBy("word")
    of = lambda k, x: F.sum(F.when(F.col("p") == k, x).otherwise(0))
    counts = seen.agg(of(1, F.lit(1)).alias("in_p"), *[of(k, F.col("v") ** e).alias(f"s{k}{e}") for k in (0, 1) for e in (1, 2)])
    mean = {k: F.col(f"s{k}1") / n for k, n in ((0, n_u), (1, n_p))}
    error = [(F.greatest(F.col(f"s{k}2") / n - mean[k] ** 2, F.lit(0.0)) + 0.05 / n) / n for k, n in ((0, n_u), (1, n_p))]
    z = F.round((mean[1] - mean[0]) / F.sqrt(error[0] + error[1]), 6)
    marked = counts.where(F.col("in_p") >= max(2, n_p // 100)).withColumn("z", z)
    top = marked.where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "word").limit(VOCABULARY).collect()
    chosen = distinct_stems([r["word"] for r in top])
    index = {w: i for i, w in enumerate(chosen)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = [marks(t) for t in part["text"].to_pylist()]
            has = [sorted((index[f], x[f]) for f in index.keys() & x.keys()) for x in found]
            yield pa.record_batch(
                [part["p"], pa.array([[i for i, _ in h] for h in has], pa.list_(pa.int32())), pa.array([[v for _, v in h] for h in has], pa.list_(pa.float64()))],
                ["p", "has", "v"],
            )

    rows = sample.mapInArrow(features, "p int, has array<int>, v array<double>").toPandas()
    # a bounded sample; in one order on every run
    ordered = sorted((p, tuple(h), tuple(v)) for p, h, v in zip(rows["p"], rows["has"], rows["v"], strict=True))
    values = np.zeros((len(ordered), len(chosen)))
    for i, (_, has, v) in enumerate(ordered):
        values[i, list(has)] = v
    weights, bias = fit_nnpu(values, np.array([p == 1 for p, _, _ in ordered]), prior)
    return Model(chosen, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = model.scores(part["text"].to_pylist())
            yield pa.record_batch([part["doc_id"], pa.array(found)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all their columns kept."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            keep = model.scores(part["text"].to_pylist()) < threshold
            yield part.filter(pa.array(keep)).select(names)

    return docs.mapInArrow(run, docs.schema)
