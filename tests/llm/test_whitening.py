from fractions import Fraction

import numpy as np
import pytest

from conftest import SF001, SF0001
from pdcspark.llm import whitening as W
from pdcspark.llm.common import table
from pdcspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, id string, x string, d string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash", "clash") for i, v in rows], SCHEMA)


def brute(rows, scale=64, offset=1_000_000):
    """The contract's figures of vectors of one length, by numpy's own eigenvectors and exact deviations."""
    x = np.floor(np.array([v for _, v in rows], float) * scale).astype(np.int64) + offset
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, e[::-1], u[:, ::-1], centred


@pytest.mark.parametrize("sf", [SF001, SF0001])
def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    n, deviation, e, u, centred = brute(rows)
    got = QUERIES["op11_whitening"](spark, sf).collect()
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    place = {v: i for i, (v, _) in enumerate(rows)}
    white = np.full((n, 32), np.nan)
    for r in got:
        white[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]]
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-10)
        assert 0 <= r.identity_error < 1e-9
    expected = centred @ u[:, :32] / np.sqrt(e[:32])
    signs = np.sign((expected * white).sum(axis=0))
    assert np.abs(white - expected * signs).max() < 1e-7
    assert np.abs(white.T @ white / n - np.eye(32)).max() < 1e-9


def test_eigen_system():
    rng = np.random.default_rng(3)
    for d, scales in ((1, [3.0]), (5, [1, 1, 1, 1, 1]), (8, 10.0 ** -np.arange(8)), (33, 10.0 ** (-np.arange(33) / 3))):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        v = (q * np.array(scales, float)) @ q.T
        g = W.pivoted_cholesky(v)
        assert np.abs(g @ g.T - v).max() < 1e-13 * np.abs(v).max()
        rotated = W.one_sided_jacobi(g)
        e = np.sort((rotated**2).sum(axis=0))[::-1]
        assert e[0] == pytest.approx(max(scales), rel=1e-12)
        assert np.abs(rotated @ rotated.T - v).max() < 1e-13 * np.abs(v).max()
        off = rotated.T @ rotated - np.diag((rotated**2).sum(axis=0))
        norms = np.sqrt((rotated**2).sum(axis=0))
        assert np.abs(off / np.outer(norms, norms)).max() < 1e-13


def test_factor_is_triangular_in_pivot_order():
    v = np.cov(np.random.default_rng(1).normal(size=(6, 40)))
    g = W.pivoted_cholesky(v)
    order = np.argsort([np.flatnonzero(row).max() for row in g])
    assert np.allclose(g[order], np.tril(g[order]))


def test_far_from_zero_is_exact(spark):
    """Entries of a large mean and a small spread: exact sums keep all digits."""
    rng = np.random.default_rng(9)
    rows = [(i, (1e6 + rng.integers(-3, 4, size=4) / 64).tolist()) for i in range(200)]
    got = W.whitened(vectors(spark, rows).repartition(5)).collect()
    n, deviation, e, u, centred = brute(rows)
    assert [r.deviation for r in sorted(got, key=lambda r: r.vec_id)] == deviation
    assert got[0].explained == pytest.approx(list(e / e.sum()), rel=1e-9)
    assert got[0].identity_error < 1e-9


def test_rank_and_lengths(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]  # rank 1
    short = [(100 + i, [float(i % 4), float(i % 3)]) for i in range(24)]
    alone = [(200, [1.0, 2.0, 3.0, 4.0])]
    empty = [(300, []), (301, [])]
    white = W.whitened(vectors(spark, flat + short + alone + empty))
    got = {r.vec_id: r for r in white.collect()}
    assert {len(got[i].whitened) for i in range(20)} == {1} and got[0].n == 20
    assert got[0].explained == [pytest.approx(1.0)] and got[0].identity_error < 1e-12
    assert {len(got[100 + i].whitened) for i in range(24)} == {2} and got[100].n == 24
    assert (got[200].whitened, got[200].n, got[200].deviation, got[200].explained) == ([], 1, 0, [])
    assert (got[300].whitened, got[300].deviation) == ([], 0)
    assert W.long_form(white).count() == 20 + 48


def test_edges(spark):
    fine = [(i, [float(i % 5), float(i % 7), float(i % 3)]) for i in range(30)]
    left_out = [(40, None), (41, [1.0, None, 2.0]), (42, [1.0, float("nan"), 2.0]), (43, [float("inf"), 0.0, 0.0]), (44, [float("-inf"), 0.0, 0.0])]
    repeated = [(3, fine[3][1]), (None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    got = W.whitened(vectors(spark, fine + left_out + repeated), components=2).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in fine + repeated)
    assert {r.n for r in got} == {33} and {len(r.whitened) for r in got} == {2}
    assert len({tuple(r.whitened) for r in got if r.vec_id == 3}) == 1
    assert W.long_form(W.whitened(vectors(spark, []))).count() == 0
    assert W.whitened(vectors(spark, left_out)).count() == 0


def test_sums_are_whole_numbers(spark):
    """The result doesn't depend on how the rows are dealt out."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    once = {r.vec_id: r.whitened for r in W.whitened(vectors(spark, rows).repartition(1)).collect()}
    again = {r.vec_id: r.whitened for r in W.whitened(vectors(spark, rows).repartition(7)).collect()}
    assert once == again


def test_fit_is_rounded_once():
    n, sums = 3, (4, 5)
    x = np.array([[1, 1], [1, 3], [2, 1]])
    centre = np.array([1, 2])
    y = x - centre
    space = W.fitted(n, sums, lambda i, j: int((y[:, i] * y[:, j]).sum()))
    v = [[Fraction(sum((Fraction(a[i]) - Fraction(sums[i], n)) * (Fraction(a[j]) - Fraction(sums[j], n)) for a in x.tolist()), n) for j in range(2)] for i in range(2)]
    assert space.trace == float(v[0][0]) + float(v[1][1])
