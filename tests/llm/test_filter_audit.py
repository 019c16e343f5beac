import bisect
import random

import numpy as np
import pytest

from conftest import SF001, SF0001
from llm_fixture import EDGES, duck, edge_docs, labels_of, same_rows
from pdcspark.llm import filter_audit as A
from pdcspark.llm.oracles import ORACLES
from pdcspark.llm.queries import QUERIES

LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (6, None, 1), (7, 0, 0), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("sf", [SF001, SF0001])
def test_query_equals_sql(spark, sf):
    assert same_rows(QUERIES["op13_filter_audit"](spark, sf), duck(sf), ORACLES["op13_filter_audit"])


def test_posting_lists():
    rng = random.Random(5)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 50))) for _ in range(rng.randrange(1, 5))]
        first, rest = lists[0], lists[1:]
        assert A.without(first, rest) == sorted(set(first).difference(*rest))
        assert A.union(lists) == sorted(set().union(*lists))
        for least in range(-1, 62):
            at = rng.randrange(0, len(first) + 1)
            assert A.gallop(first, least, at) == max(at, bisect.bisect_left(first, least))


def brute(rows, filters, n_flags):
    """(part, fails, flags) rows -> every step of every order, one document at a time."""
    from itertools import permutations

    out, shapley = {}, {}
    parts = {p for p, _, _ in rows}
    for part in parts:
        own = [(f, g) for p, f, g in rows if p == part]
        for order in map("".join, permutations(filters)):
            left = list(range(len(own)))
            for step, letter in enumerate(order, 1):
                bit = 1 << filters.index(letter)
                gone = [i for i in left if own[i][0] & bit]
                left = [i for i in left if not own[i][0] & bit]
                failing = [i for i in range(len(own)) if own[i][0] & bit]
                lost = [sum(own[i][1] >> g & 1 for i in gone) for g in range(n_flags)]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(own[i][0] == bit for i in failing), *lost]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("filters,n_flags", [("ABCDE", 2), ("XYZ", 1), ("Q", 0)])
def test_audit_equals_brute_force(spark, monkeypatch, filters, n_flags):
    monkeypatch.setattr(A, "RANGE_ROWS", 7)  # many ranges
    rng = np.random.default_rng(len(filters))
    rows = [(f"p{rng.integers(3)}", None if rng.random() < 0.1 else int(rng.integers(20)), int(rng.integers(1 << len(filters))), int(rng.integers(1 << n_flags))) for _ in range(90)]
    rows += [("all pass", 1, 0, 0), ("all fail", 2, (1 << len(filters)) - 1, 0)]
    marked = spark.createDataFrame(rows, "part string, id long, fails long, flags long").repartition(4)
    flags = ("good", "toxic")[:n_flags]
    got = A.audit(marked, filters, flags)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{f}_lost" for f in flags), "shapley"]
    found = {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()}
    assert found == brute([(p, f, g) for p, _, f, g in rows], filters, n_flags)


def test_a_hot_part_is_spread(spark):
    """A third of the rows and more in one part, one id and one text: every task lists its own range."""
    docs = [(1 if i % 2 else i, "same text" if i % 3 == 0 else f"text {i}", "en", "hot" if i % 5 else "other") for i in range(600)]
    marked = A.marked(edge_docs(spark, docs).repartition(8), labels_of(spark, LABELS))
    assert marked.count() == 600
    rows = [tuple(r) for r in marked.select("part", "fails", "flags").collect()]
    found = {(r[0], r[1], r[2]): tuple(r[3:]) for r in A.audit(marked, "ABCDE", ("good", "toxic")).collect()}
    assert found == brute(rows, "ABCDE", 2)


def test_five_filters():
    assert A.fails_of(b"") == 1
    assert A.fails_of(b"w " * 200) == 2
    assert A.fails_of(" ".join(f"w{i}" for i in range(200)).encode()) == 0
    assert A.fails_of(" ".join(f"w{i // 2}" for i in range(200)).encode()) == 0  # exactly half
    assert A.fails_of(("A" * 2 + "é" * 98).encode()) == 1  # exactly 2 of 100 code points
    assert A.fails_of(("A" * 3 + "é" * 97).encode()) == 1 | 4
    assert [A.fails_of(f"a{c}".encode()) & 8 for c in "#$%&*|"] == [8] * 6
    assert A.fails_of("a!@^()ÀÉ".encode()) == 1


def test_edges(spark):
    marked = A.marked(edge_docs(spark), labels_of(spark, LABELS)).collect()
    assert len(marked) == len(EDGES)
    later = sorted((r.id is None, r.id) for r in marked if r.fails & 16)
    # Copies of a smaller id's text: both rows of doc 2, and 4 (empty as 3's null is); a null id is neither side.
    assert later == [(False, 2), (False, 2), (False, 4)]
    assert {r.part for r in marked if r.id in (None, 4)} == {""}
    assert {r.id: r.flags for r in marked if r.flags} == {1: 3, 2: 1, 6: 2}
    both = A.audit(A.marked(edge_docs(spark), labels_of(spark, LABELS)), "ABCDE", ("good", "toxic"))
    assert both.count() == 600 * 5  # parts a, b, c, é and the empty one
    assert A.audit(A.marked(edge_docs(spark, []), labels_of(spark, [])), "ABCDE").count() == 0
    with pytest.raises(ValueError):
        A.audit(A.marked(edge_docs(spark, []), labels_of(spark, [])), "ABCDEFG")
