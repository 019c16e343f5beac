from fractions import Fraction

import pytest

from conftest import SF001, SF0001
from llm_fixture import EDGES, duck, edge_docs, same_rows
from pdcspark.llm import mixing
from pdcspark.llm.oracles import ORACLES
from pdcspark.llm.queries import QUERIES


@pytest.mark.parametrize("sf", [SF001, SF0001])
def test_query_equals_sql(spark, sf):
    assert same_rows(QUERIES["op9_mixing"](spark, sf), duck(sf), ORACLES["op9_mixing"])


def brute_targets(sizes):
    """Reshare the excess by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: Fraction(2 * sizes[s]) if s in capped else left * weight[s] / sum(weight[x] for x in rest) for s in names}
        above = {s for s in rest if target[s] > 2 * sizes[s]}
        if not above:
            return {s: float(t) for s, t in target.items()}
        capped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 7, None: 300}, {"a": 5}, {"a": 0, "b": 0}, {"b": 0, "a": 9, "é": 4, "z": 100, "zz": 1}, {None: 3}, {"a": 1, "b": 10**12}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(brute_targets(sizes))


def test_taken_is_near_the_target_and_reruns_agree(spark):
    rows = QUERIES["op9_mixing"](spark, SF001).collect()
    assert sorted(rows) == sorted(QUERIES["op9_mixing"](spark, SF001).collect())
    by = {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        s = by.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.taken
        s[1] = max(s[1], r.size)
    for (_, target), (taken, largest) in by.items():
        assert abs(taken - target) <= largest / 2 + 1


def test_edges(spark):
    got = mixing.mix_sizes(edge_docs(spark)).collect()
    assert len(got) == len(EDGES)
    assert sorted(r.size for r in got) == sorted(len((t or "").encode().split()) for _, t, _, _ in EDGES)
    assert mixing.mix_sizes(edge_docs(spark, [])).count() == 0
    blank = mixing.mix_sizes(edge_docs(spark, [(1, None, None, None), (2, " ", "en", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def test_mix_repeats_rows(spark):
    docs = edge_docs(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = sum(r.taken for r in mixing.mix_sizes(docs).collect())
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == taken
    assert mixing.mix(edge_docs(spark, [])).count() == 0
