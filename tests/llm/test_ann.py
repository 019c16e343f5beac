import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from pdcspark.llm import ann
from pdcspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, score string, class string, list string, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", "c", "c", "c") for i, v in rows], SCHEMA)


def brute(rows, k=5, every=50):
    """{query id: [(score, id)]}, nearest first."""
    ok, vectors = [], {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            ok.append((i, tuple(np.array(v, np.float32).astype(float))))
    ok = sorted(set(ok))
    vectors = np.array([v for _, v in ok])
    lengths = np.linalg.norm(vectors, axis=1)
    out = {}
    for q, (i, v) in enumerate(ok):
        if i % every == 0:
            scores = vectors @ vectors[q] / (lengths * lengths[q])
            out[i] = sorted(((-round(s, 12), j) for s, (j, _) in zip(scores, ok, strict=True) if j != i))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, -round(r.score, 12), r.vec_id))
    return {q: [(s, i) for _, s, i in sorted(rs)] for q, rs in out.items()}


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op3_nearest_neighbours"](spark, SF001)), brute(rows)
    assert set(got) == set(want)
    assert all(len(r) == 5 for r in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    by_id = {i: np.array(v, float) for i, v in rows}
    for q, r in got.items():
        assert r == sorted(r)
        for s, i in r:
            assert -s == pytest.approx(by_id[q] @ by_id[i] / (np.linalg.norm(by_id[q]) * np.linalg.norm(by_id[i])), abs=1e-12)


def test_recall_with_many_small_lists(spark, monkeypatch):
    """Clustered vectors on more lists than a query may read, in blocks of a few rows."""
    monkeypatch.setattr(ann, "PER_CENTROID", 20)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * draw.normal(size=16)).astype(np.float32).tolist()) for i in range(2000)]
    got, want = found(ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows)
    hits = sum(len(set(i for _, i in got[q]) & set(i for _, i in want[q])) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_edges_against_brute_force(spark):
    """Few rows are all on lists that every query reads, so the search is exact."""
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(1)
    hot = [1.0, 2.0, -1.0, 0.5]
    rows = [(i, draw.normal(size=4).astype(np.float32).tolist()) for i in range(1, 40)]
    rows += [(i, hot) for i in range(100, 160)] + [(100, hot), (200, [-x for x in hot]), (250, hot), (250, [2 * x for x in hot])]
    rows += [(300, None), (350, [0.0] * 4), (400, [nan, 1, 1, 1]), (450, [inf, 1, 1, 1]), (500, [None, 1, 1, 1]), (None, hot), (550, [])]
    got, want = found(ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows)
    assert set(got) == {100, 150, 200, 250}
    assert got[100] == want[100] and got[150] == want[150] and got[200] == want[200]
    assert [i for _, i in got[100]] == [101, 102, 103, 104, 105]


def test_few_and_no_rows(spark):
    assert ann.nearest(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(table(spark, [(50, None)]), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(table(spark, [(50, [1.0, 0.0])]), F.col("vec_id") % 50 == 0).count() == 0
    rows = [(50, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0, 0.0])]
    got = found(ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0))
    assert {q: [i for _, i in r] for q, r in got.items()} == {50: [2, 1]}  # the odd length takes no part


def test_graph_search_finds_the_nearest_centroids():
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(3000, 12))
    centroids = ann.fit(vectors)
    unit = ann._unit(vectors[:500])
    ids, distances = centroids.nearest(unit, beam=32)
    assert (np.diff(distances, axis=1) >= 0).all()
    assert (ids[:, 0] == np.argmax(unit @ centroids.vectors.T, axis=1)).mean() >= 0.97
    assert all(len(set(row)) == len(row) for row in ids.tolist())


def test_many_scaled_copies_go_to_the_smallest_ids(spark):
    """More vectors of equal cosine than are wanted: powers of two keep the cosines equal to the last bit."""
    far, tied = [[1.0, -0.001 * i] for i in range(40)], [[3.0 * 2.0**e, 4.0 * 2.0**e] for e in range(60)]
    rows = list(enumerate(far + tied))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(vectors, is_query=F.col("vec_id") == 99, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [40, 41, 42, 43, 44]
