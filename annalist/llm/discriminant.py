"""Document quality by a regularised quadratic discriminant.

Each text becomes a few transformed statistics.  Each class is a Gaussian over
them whose covariance is shrunk twice: towards the pooled covariance, then
towards a multiple of the identity.  Its Cholesky factor is taken once, in
training, and kept in the model; a score is the logistic of the difference of
the two log densities, which are Mahalanobis distances by that factor.

Nulls and oddities: a null text is scored as an empty one; repeated rows get
equal scores; a null doc_id is held out; with fewer than two labelled texts of
a class, every score is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import bounded_ids, held_out, text_slices, utf8_of
from annalist.llm.textkit import NOT_SPACE, Words

#: Labelled texts learnt from, at most.
LABELLED_BOUND = 20_000
#: Weight of the pooled covariance, then that of the identity.
POOLING, RIDGE = 0.3, 0.1
#: Letters added to a text's length in its shares.
DAMPING = 60

KINDS = {
    "upper": lambda b: 65 <= b <= 90,
    "lower": lambda b: 97 <= b <= 122,
    "digit": lambda b: 48 <= b <= 57,
    "mark": lambda b: chr(b) in "#*$%&|<>@^~=+_{}[]\\/",
    "point": lambda b: chr(b) in ".,;:!?'\"()-",
    "shout": lambda b: chr(b) in "!?",
    "line": lambda b: b == 10,
    "space": lambda b: b == 32 or 9 <= b <= 13,
}
TABLES = {k: np.array([b < 128 and bool(f(b)) for b in range(256)]) for k, f in KINDS.items()}


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    data, offsets = utf8_of(texts)
    words = Words(data, offsets, NOT_SPACE, lower=False)
    size = np.diff(offsets)
    n_words = words.counts
    per = {}
    for kind, members in TABLES.items():
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(members[data], out=sums[1:])
        per[kind] = sums[offsets[1:]] - sums[offsets[:-1]]
    owner = np.repeat(np.arange(len(size)), n_words)

    def distinct(hashes: np.ndarray, whose: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, whose))
        h, o = hashes[order], whose[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[fresh], minlength=len(size))

    at, pairs = words.ngrams(2)
    words_in, pairs_in = np.maximum(n_words, 1), np.bincount(owner[at], minlength=len(size))
    length = size + DAMPING  # so that a few letters do not make an extreme share
    share = lambda k: np.sqrt(per[k] / length)
    return np.column_stack(
        [
            np.log1p(n_words),
            np.log1p((size - per["space"]) / words_in),
            share("upper"),
            share("digit"),
            share("mark"),
            share("point"),
            share("shout"),
            np.sqrt(per["line"] / (n_words + DAMPING / 6)),
            np.sqrt(per["upper"] / (per["upper"] + per["lower"] + DAMPING)),
            np.log((distinct(words.hashes, owner) + 3) / (n_words + 3)),
            np.log((distinct(pairs, owner[at]) + 3) / (pairs_in + 3)),
        ]
    ).astype(float)


@dataclass(frozen=True)
class Model:
    """Per class: log prior less half the log determinant, mean, inverse Cholesky factor; ``flat``: a constant score."""

    classes: tuple[tuple[float, np.ndarray, np.ndarray], ...]
    centre: np.ndarray
    scale: np.ndarray
    flat: float | None = None

    def scores(self, values: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(values), self.flat)
        x = (values - self.centre) / self.scale
        density = [base - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for base, mean, inverse in self.classes]
        return 0.5 * (1 + np.tanh(0.5 * (density[1] - density[0])))


def fit(values: np.ndarray, good: np.ndarray, pooling: float = POOLING, ridge: float = RIDGE) -> Model:
    """The discriminant of good against other rows."""
    width = values.shape[1]
    centre, scale = np.zeros(width), np.ones(width)
    if min(good.sum(), (~good).sum()) < 2:
        return Model((), centre, scale, float(good.mean()) if len(good) else 0.5)
    centre, scale = values.mean(axis=0), values.std(axis=0) + 1e-6
    x = (values - centre) / scale
    parts = [x[~good], x[good]]
    own = [np.cov(p, rowvar=False, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(x)
    classes = []
    for p, c in zip(parts, own, strict=True):
        shrunk = (1 - pooling) * c + pooling * pooled
        shrunk = (1 - ridge) * shrunk + ridge * np.trace(shrunk) / width * np.eye(width)
        factor = np.linalg.cholesky(shrunk)
        base = float(np.log(len(p) / len(x)) - np.log(np.diag(factor)).sum())
        classes.append((base, p.mean(axis=0), np.linalg.inv(factor)))
    return Model(tuple(classes), centre, scale)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of the labelled texts of the training folds."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    # one label for each id, so that repeated label rows add no text twice
    known = known.groupBy("doc_id").agg(F.max("quality").alias("good"))
    picked = bounded_ids(known, "doc_id", LABELLED_BOUND).join(known, "doc_id")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked.limit(LABELLED_BOUND)), "doc_id")
    names = [f"x{i}" for i in range(len(statistics(pa.array([""]))[0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield pa.record_batch([part["good"], *map(pa.array, statistics(part["text"]).T.copy())], ["good", *names])

    good_type = sample.schema["good"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"good {good_type}, " + ", ".join(f"{n} double" for n in names)).toPandas()
    rows = rows.sort_values(["good", *names])  # a bounded sample; in one order on every run
    return fit(rows[names].to_numpy(float), rows["good"].to_numpy() == 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier good) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield pa.record_batch([part["doc_id"], pa.array(model.scores(statistics(part["text"])))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
