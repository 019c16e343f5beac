"""Quality by a vote of the nearest labelled documents in a latent semantic space.

Terms are words and the shapes of words (``THE!!`` and ``WAS!!`` share one),
and the repetition of a word right after itself; they are hashed to a fixed
number of dimensions, weighted by the logarithm of their counts and their
rareness, and projected to few dimensions by a truncated singular value
decomposition of a bounded labelled sample.  The sample's vectors are broadcast
(``SAMPLE x LATENT`` numbers).  Each document is compared with all of them
exactly, in blocks of matrix products, and its nearest neighbours vote with
their labels, weighted by their cosine.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark.llm.labelled import held_out, training_rows

WORD_DIMS, SHAPE_DIMS = 2048, 1024
DIMS = WORD_DIMS + SHAPE_DIMS + 1  # the last: a word right after itself
LATENT, SAMPLE, NEIGHBOURS, SHARPNESS = 48, 4000, 25, 8
THRESHOLD = 0.3
#: Shapes say more of quality than words, and words that follow themselves most.
SHAPE_WEIGHT, AGAIN_WEIGHT = 3.0, 9.0
CACHED, BLOCK = 150_000, 512
_LOWER, _UPPER, _DIGITS, _SAME = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), re.compile(r"\d+"), re.compile(r"([^\w])\1+")


def shape(word: str) -> str:
    """Runs of lower case, capitals, digits and of one other sign become one character each."""
    return _SAME.sub(r"\1", _DIGITS.sub("9", _LOWER.sub("a", _UPPER.sub("AA", word))))


class Terms:
    """The term counts of texts as sparse rows; remembers the dimensions of words."""

    def __init__(self):
        self.places: dict[str, tuple[int, int]] = {}

    def _place(self, word: str) -> tuple[int, int]:
        plain = word.lower().strip(".,;:!?")
        return zlib.crc32(plain.encode()) % WORD_DIMS, WORD_DIMS + zlib.crc32(shape(word).encode()) % SHAPE_DIMS

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        counts: dict[int, int] = {}
        for word, n in Counter(words).items():
            places = self.places.get(word)
            if places is None:
                if len(self.places) >= CACHED:
                    self.places.clear()
                places = self._place(word)
                if len(word) < 64:
                    self.places[word] = places
            for p in places:
                counts[p] = counts.get(p, 0) + n
        again = sum(map(eq, words, words[1:]))
        if again:
            counts[DIMS - 1] = again
        values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        return np.fromiter(counts, np.int64, len(counts)), values


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1)


@dataclass
class Model:
    """``project``: a term's weight and place in the latent space; ``vectors`` have length 1."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def latent(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.project.shape[1]), np.float32)
        for i, (places, values) in enumerate(rows):
            out[i] = values @ self.project[places]
        return _unit(out)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The weighted share of label 1 among the nearest; the overall share without any likeness."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        out, k = [], min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(rows), BLOCK):
            likeness = self.latent(rows[start : start + BLOCK]) @ self.vectors.T
            nearest = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(likeness, nearest, 1).astype(np.float64), 0) ** SHARPNESS
            total = weight.sum(axis=1)
            votes = (weight * self.labels[nearest]).sum(axis=1)
            out.append(np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior))
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, latent: int = LATENT) -> Model:
    """Truncated SVD of the weighted term rows, by a sketch and two power steps."""
    labels = labels.astype(np.float64)
    if not rows:
        return Model(np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (places, values) in enumerate(rows):
        x[i, places] = values
    rareness = np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    rareness[WORD_DIMS:] *= SHAPE_WEIGHT
    rareness[-1] *= AGAIN_WEIGHT / SHAPE_WEIGHT
    x = _unit(x * rareness)
    width = min(latent + 8, *x.shape)
    basis = x @ np.random.default_rng(0).standard_normal((DIMS, width), np.float32)
    for _ in range(2):
        basis = x @ (x.T @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    axes = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:latent]
    project = np.ascontiguousarray((axes * rareness).T, np.float32)
    model = Model(project, np.zeros((0, project.shape[1]), np.float32), labels)
    model.vectors = model.latent(rows)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """Learn from at most ``most`` labelled rows; their sparse term rows come to the driver."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for batch in batches:
            found = [terms.row(t) for t in batch["text"]]
            yield pd.DataFrame({"places": [p for p, _ in found], "counts": [v for _, v in found], "y": batch["y"]})

    sample = training_rows(docs, labels, label, most).mapInPandas(rows, "places array<int>, counts array<float>, y int")
    got = sample.toArrow()
    rows_of = zip(*(got[c] for c in ("places", "counts", "y")), strict=True)
    found = [(p.values.to_numpy().astype(np.int64), v.values.to_numpy(), y.as_py()) for p, v, y in rows_of]
    found.sort(key=lambda row: (row[0].tobytes(), row[1].tobytes(), row[2]))  # the order of rows is Spark's own
    return fit([row[:2] for row in found], np.array([row[2] for row in found]))


def scorer(docs: DataFrame, model: Model):
    """A column function text -> score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for texts in batches:
            yield pd.Series(sent.value.scores([terms.row(t) for t in texts]))

    return lambda text: score(text.cast("string"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    Null, empty and blank texts have no terms and score the share of label 1 in
    the sample; without any labelled row every score is 0.5.  Repeated rows
    stay.  Only doc_id and text are read, doc_id for the folds alone.
    """
    score = scorer(docs, train(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns.

    A null or empty text, or one without a known term, scores the share of
    label 1 among the learned rows, so it stays where most of them are good;
    without any labelled row every text scores 0.5 and stays.  Equal texts score
    alike, repeated rows stay or go together, and an empty table stays empty.
    """
    score = scorer(docs, train(docs, labels))
    return docs.where(score(F.col("text")) >= THRESHOLD)
