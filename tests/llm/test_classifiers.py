import math
import re
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from conftest import SF0001, SF001
from llm_fixture import EDGES, edge_docs, labels_of
from pdcspark.llm import labelled, quality_knn, toxicity_fm
from pdcspark.llm.queries import QUERIES


def accuracy(spark, query, label):
    """Share of held-out labelled rows that are predicted right, of label 0 and of label 1."""
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    rows = [r for r in QUERIES[query](spark, SF001).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 for r in rows)
    return [np.mean([r.predicted == y for r in rows if labels[r.doc_id] == y]) for y in (0, 1)]


def test_quality_held_out(spark):
    bad, good = accuracy(spark, "op4_quality_classifier", "quality")
    assert bad >= 0.75 and good >= 0.97


def test_toxicity_held_out(spark):
    clean, toxic = accuracy(spark, "op6_toxicity", "toxic")
    assert clean >= 0.97 and toxic >= 0.55


def test_folds(spark):
    got = spark.range(500).select("id", labelled.held_out(F.col("id")).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = labels_of(spark, [(i, 0, 1) for i in held] + [(None, 0, 1), (7, None, None)])
    assert labelled.training_rows(docs, labels, "quality", 100).count() == 0
    assert {r.score for r in quality_knn.quality(docs, labels).collect()} == {0.5}
    assert {r.score for r in toxicity_fm.toxicity(docs, labels).collect()} == {0.5}


def test_the_sample_is_bounded_and_repeatable(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(100)] * 2)
    rows = labelled.training_rows(docs, labels, "quality", 10)
    assert rows.count() == 10


def test_knn_against_brute_force():
    draw = np.random.default_rng(0)
    texts = ["good words in a row " + str(i) for i in range(30)] + ["BAD!! WORDS!! " * (i + 1) for i in range(15)]
    terms = quality_knn.Terms()
    rows, y = [terms.row(t) for t in texts], np.array([1] * 30 + [0] * 15)
    model = quality_knn.fit(rows, y)
    order = draw.permutation(len(rows))
    scores = model.scores([rows[i] for i in order])
    vectors = model.latent(rows)
    for i, s in zip(order, scores, strict=True):
        cosine = np.array([float(vectors[i] @ v) for v in model.vectors])
        near = np.argsort(-cosine, kind="stable")[: quality_knn.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** quality_knn.SHARPNESS
        assert abs(s - (weight * y[near]).sum() / weight.sum()) < 1e-3
    assert ((scores >= quality_knn.THRESHOLD) == y[order].astype(bool)).all()


def test_machine_learns_a_pair():
    """Neither word alone is toxic, the two together are: additive weights cannot tell."""
    rows, y = [], []
    for a in (0, 1):
        for b in (0, 1):
            rows += [np.array([i for i, on in enumerate((a, b)) if on] + [2], np.int64)] * 100
            y += [float(a and b)] * 100
    model = toxicity_fm.fit(rows, np.array(y), {10: 0, 20: 1, 30: 2})
    scores = model.scores([np.array(r, np.int64) for r in ([2], [0, 2], [1, 2], [0, 1, 2])])
    assert (scores[:3] < 0.2).all() and scores[3] > 0.8


def edges(spark, operator):
    labels = labels_of(spark, [(1, 1, 0), (2, 1, 0), (2, 0, 1), (6, 0, 1), (None, 1, 1), (99, 1, 1), (3, None, 0)])
    docs = edge_docs(spark)
    got = operator(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in EDGES)
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert operator(docs, labels_of(spark, [])).count() == len(EDGES)
    assert operator(edge_docs(spark, []), labels).count() == 0


def test_quality_edges(spark):
    edges(spark, quality_knn.quality)
    docs = edge_docs(spark)
    kept = quality_knn.keep(docs, labels_of(spark, []))
    assert kept.columns == docs.columns and kept.count() == len(EDGES)


def test_toxicity_edges(spark):
    edges(spark, toxicity_fm.toxicity)


def test_a_pair_of_neutral_words_is_learned_from_texts(spark):
    """Half of the texts with alpha are toxic, as of those with beta, and of all: only the pair tells."""
    texts = [("filler alpha beta", 1), ("filler alpha", 0), ("filler beta", 0), ("filler slur", 1)]
    docs = edge_docs(spark, [(i, texts[i % 4][0], "en", "a") for i in range(400)])
    got = toxicity_fm.toxicity(docs, labels_of(spark, [(i, 1, texts[i % 4][1]) for i in range(400)])).collect()
    assert len(got) == 400 and all(r.predicted == texts[r.doc_id % 4][1] for r in got)


def test_a_repeated_row_is_sampled_once(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, "c")] + [(1, t) for t in "abab"], "doc_id long, text string")
    got = labelled.training_rows(docs, labels_of(spark, [(1, 1, 0), (2, 0, 1)]), "quality", 10).collect()
    assert sorted(r.y for r in got) == [0, 1] and {r.text for r in got if r.y == 0} == {"c"}


def brute_toxicity(model, text):
    """The machine's score from its formula: every pair of a text's features by itself."""
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    marked = {f"w:{w}" for w in words} | {f"{n}:{w[:n]}" for w in words for n in toxicity_fm.BEGINNINGS if len(w) > n}
    hashed = {zlib.crc32(m.encode()) % toxicity_fm.TERMS for m in marked}
    places = sorted(model.terms[h] for h in hashed if h in model.terms)
    z = model.bias + sum(float(model.weights[i]) for i in places)
    z += sum(float(model.factors[i] @ model.factors[j]) for i, j in combinations(places, 2))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF0001}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity_fm.train(docs, labels)
    got = toxicity_fm.toxicity(docs, labels).collect()
    assert model.terms and np.abs(model.factors).max() > 0.05 and len(got) == len(texts)
    for r in got:
        assert abs(r.score - brute_toxicity(model, texts[r.doc_id])) < 1e-9
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_gradients_of_the_machine():
    """One step of the training from a known start moves each parameter against its numerical gradient."""
    rows, y = [np.array(r, np.int64) for r in ([0, 1], [1, 2], [0], [2])], np.array([1.0, 0.0, 0.0, 1.0])
    terms = {10: 0, 20: 1, 30: 2}

    def loss(model):
        p = model.scores(rows)
        decay = toxicity_fm.DECAY / 2 * ((model.weights**2).sum() + (model.factors**2).sum())
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + decay

    epochs, toxicity_fm.EPOCHS = toxicity_fm.EPOCHS, 1
    try:
        after = toxicity_fm.fit(rows, y, terms)
        start = toxicity_fm.fit(rows, y[:0], terms)  # no label: the start itself
    finally:
        toxicity_fm.EPOCHS = epochs
    start.bias = math.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1)))
    for name in ("weights", "factors"):
        values, moved = getattr(start, name), getattr(after, name) - getattr(start, name)
        for at in np.ndindex(values.shape):
            values[at] += 1e-6
            up = loss(start)
            values[at] -= 2e-6
            down = loss(start)
            values[at] += 1e-6
            gradient = (up - down) / 2e-6
            # Adam's first step has the rate's length but for gradients near its epsilon.
            expected = -toxicity_fm.RATE * gradient / (abs(gradient) + 1e-8 / math.sqrt(0.001))
            assert abs(moved[at] - expected) < 0.01 * toxicity_fm.RATE


def test_dividing_terms_against_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(sorted(set(draw.integers(0, 40, 6).tolist())) + [99] * int(i % 4 == 0), int(i % 4 == 0)) for i in range(200)]
    n, n1, toxic = {}, {}, sum(y for _, y in rows)
    for terms, y in rows:
        for t in terms:
            n[t], n1[t] = n.get(t, 0) + 1, n1.get(t, 0) + y

    def ratio(t):
        cells = [(n1[t], n[t] * toxic), (n[t] - n1[t], n[t] * (200 - toxic)), (toxic - n1[t], (200 - n[t]) * toxic), (200 - n[t] - toxic + n1[t], (200 - n[t]) * (200 - toxic))]
        return sum(o * math.log(o * 200 / e) for o, e in cells if o)

    best = sorted((t for t in n if n[t] > 2 and ratio(t) >= toxicity_fm.LEAST_RATIO), key=lambda t: (-ratio(t), t))
    rest = sorted((t for t in n if n[t] > 2 and t not in best), key=lambda t: (-n[t], t))
    got = toxicity_fm._dividing_terms(spark.createDataFrame(rows, "terms array<int>, y int"))
    assert got == best + rest and best[0] == 99


def test_labels_with_other_columns(spark):
    """Columns of the labels table with the names of documents' columns or of an operator's own change nothing."""
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    plain = spark.read.parquet(f"{SF0001}/labels.parquet")
    wide = plain.selectExpr("'x' AS text", "*", "'y' AS y", "0.5D AS score", "'de' AS lang", "1 AS held_out", "1 AS n", "array(1) AS terms")
    for operator in (quality_knn.quality, toxicity_fm.toxicity):
        a, b = ({r.doc_id: r.score for r in operator(docs, labels).collect()} for labels in (plain, wide))
        assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)
