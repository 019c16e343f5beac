"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their beginnings, hashed.  Features are the
terms that divide the labelled sample best (by a likelihood ratio), up to half
of the places, and then the most frequent others, since terms that say nothing
alone may say much as a pair.  A
second-order factorization machine learns a weight for each and a vector whose
products weigh pairs of features: an insult beside the mention of a group can
count more than the two alone.  Both the sample and the features are bounded,
and so is the broadcast model (``FEATURES`` x (``FACTORS`` + 1) numbers).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark.llm.common import cut
from pdcspark.llm.labelled import held_out, training_rows

TERMS, BEGINNINGS = 1 << 22, (3, 4, 5, 6)
SAMPLE, FEATURES, FACTORS = 12_000, 3_000, 8
#: Least likelihood ratio of a term that divides (chi-square at 0.5 %).
LEAST_RATIO = 7.9
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.03, 2e-4
THRESHOLD = 0.5
CACHED = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[int]:
    """The hashed terms of one lower-case word."""
    marked = [f"w:{word}", *(f"{n}:{word[:n]}" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(t.encode()) % TERMS for t in marked]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Model:
    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, places in enumerate(rows):
            v = self.factors[places]
            pairs = 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
            out[i] = self.bias + self.weights[places].sum() + pairs
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


class Features:
    """The features of texts; remembers those of words."""

    def __init__(self, terms: dict[int, int]):
        self.terms = terms
        self.of_word: dict[str, tuple[int, ...]] = {}

    def _learn(self, word: str) -> tuple[int, ...]:
        if len(self.of_word) >= CACHED:
            self.of_word.clear()
        found = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
        if len(word) < 64:
            self.of_word[word] = found
        return found

    def row(self, text: str | None) -> np.ndarray:
        places: set[int] = set()
        known = self.of_word
        for word in words_of(text):
            found = known.get(word)
            if found is None:
                found = self._learn(word)
            if found:
                places.update(found)
        return np.array(sorted(places), np.int64)


def fit(rows: list[np.ndarray], y: np.ndarray, terms: dict[int, int]) -> Model:
    """Logistic loss by Adam in a fixed order of batches; labels of both kinds weigh the same in the bias alone."""
    n = len(terms)
    share = (y.sum() + 0.5) / (len(y) + 1)
    draw = np.random.default_rng(0)
    model = Model(terms, float(np.log(share / (1 - share))), np.zeros(n), draw.normal(0, 0.01, (n, FACTORS)))
    if not len(y) or not n:
        return model
    steps = [np.zeros_like(a) for a in (model.weights, model.factors, model.weights, model.factors)]
    bias = [0.0, 0.0]
    t = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for start in range(0, len(y), BATCH):
            chosen = order[start : start + BATCH]
            x = np.zeros((len(chosen), n))
            for i, r in enumerate(chosen):
                x[i, rows[r]] = 1
            xv = x @ model.factors
            z = model.bias + x @ model.weights + 0.5 * (xv**2 - x @ model.factors**2).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
            gradients = (
                x.T @ error + DECAY * model.weights,
                x.T @ (error[:, None] * xv) - (x.T @ error)[:, None] * model.factors + DECAY * model.factors,
            )
            t += 1
            rate = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, (value, gradient) in enumerate(zip((model.weights, model.factors), gradients, strict=True)):
                steps[k] += 0.1 * (gradient - steps[k])
                steps[k + 2] += 0.001 * (gradient**2 - steps[k + 2])
                value -= rate * steps[k] / (np.sqrt(steps[k + 2]) + 1e-8)
            bias[0] += 0.1 * (error.sum() - bias[0])
            bias[1] += 0.001 * (error.sum() ** 2 - bias[1])
            model.bias -= rate * bias[0] / (np.sqrt(bias[1]) + 1e-8)
    return model


def _dividing_terms(sample: DataFrame) -> list[int]:
    """The features: the terms with the largest likelihood ratios, then the most frequent ones; ties to the smaller hash."""
    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    seen = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    seen = seen.where("n > 2").withColumns({"rows": F.lit(rows), "toxic": F.lit(toxic)})

    def part(observed: str, expected: str):
        return F.expr(f"CASE WHEN ({observed}) > 0 THEN ({observed}) * ln(({observed}) / ({expected})) ELSE 0D END")

    ratio = part("n1", "n * toxic / rows") + part("n - n1", "n * (rows - toxic) / rows")
    ratio = ratio + part("toxic - n1", "(rows - n) * toxic / rows") + part("rows - n - toxic + n1", "(rows - n) * (rows - toxic) / rows")
    known = cut(seen.where("toxic > 0 and toxic < rows").select("term", "n", ratio.alias("ratio")), "terms")
    best = known.where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(FEATURES // 2)
    dividing = [r["term"] for r in best.collect()]
    others = known.where(~F.col("term").isin(dividing)) if dividing else known
    frequent = others.where(F.col("n") < rows).orderBy(F.desc("n"), "term").limit(FEATURES - len(dividing))
    return dividing + [r["term"] for r in frequent.collect()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    """Learn from at most ``most`` labelled rows; the driver gets their features only."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted({t for w in words_of(text) for t in terms_of(w)}) for text in batch["text"]]
            yield pd.DataFrame({"terms": found, "y": batch["y"]})

    sample = cut(training_rows(docs, labels, label, most).mapInPandas(hashed, "terms array<int>, y int"), "toxicity")
    terms = {t: i for i, t in enumerate(_dividing_terms(sample))}
    picked = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<int>")
    rows = sample.select(F.array_intersect("terms", picked).alias("terms"), "y").toArrow().to_pylist()
    found = sorted((sorted(terms[t] for t in r["terms"]), r["y"]) for r in rows)
    return fit([np.array(r, np.int64) for r, _ in found], np.array([y for _, y in found], np.float64), terms)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    A text without a known feature, so also a null or empty one, scores what
    the bias says; without any labelled row that is 0.5, and every row is
    predicted 1, as the threshold has it.  Repeated rows stay.  Only doc_id and
    text are read, doc_id for the folds alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        features = Features(model.terms)
        for texts in batches:
            yield pd.Series(model.scores([features.row(t) for t in texts]))

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
