import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash

from conftest import SF001, SF0001
from llm_fixture import EDGES, LONG, duck, edge_docs, same_rows
from pdcspark.llm import substrings as S
from pdcspark.llm.oracles import ORACLES
from pdcspark.llm.queries import QUERIES


@pytest.mark.parametrize("sf", [SF001, SF0001])
def test_query_equals_sql(spark, sf):
    assert same_rows(QUERIES["op12_substring_dedup"](spark, sf), duck(sf), ORACLES["op12_substring_dedup"])


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    times = Counter(tuple(w[p : p + window]) for w in words for p in range(len(w) - window + 1))
    out = []
    for w in words:
        covered = {p + k for p in range(len(w) - window + 1) if times[tuple(w[p : p + window])] > 1 for k in range(window)}
        out.append((len(w), len(covered), b" ".join(x for i, x in enumerate(w) if i not in covered).decode()))
    return out


def result(spark, texts, window):
    docs = edge_docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(5)
    got = S.without_repeats(docs, window=window).collect()
    return [(r.n_words, r.n_removed, r.kept) for r in sorted(got, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("window", [1, 2, 5, 35, 63])
def test_equals_brute_force(spark, window):
    rng = random.Random(window)
    common = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(1, 4 * window))) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts.append(rng.choice(common) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 3 * window))))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], "x " * 5 * window, "x y " * 3 * window]
    assert result(spark, texts, window) == brute(texts, window)


def test_small_edits_and_shifted_overlaps(spark):
    """Near copies with an edit every few dozen words, at shifted places: runs that settle and runs that don't."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        words = base[rng.randrange(100) : 300 + rng.randrange(100)]
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"edit{rng.random()}"
        texts.append(" ".join(words))
    assert result(spark, texts, 35) == brute(texts, 35)


def test_a_hot_passage(spark):
    """A passage in most documents and copies that are a third of all rows."""
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [f"start{i} {passage} end{i}" for i in range(300)] + [" ".join(f"c{i}" for i in range(80))] * 150
    got = result(spark, texts, 35)
    assert got == brute(texts, 35)
    assert got[0] == (52, 50, "start0 end0") and got[-1] == (80, 80, "")


def test_shortest_repeats(spark):
    w = [f"w{i}" for i in range(100)]
    texts = [" ".join(w[:35]), " ".join(["x", *w[:35], "y"]), " ".join(w[40:74]), " ".join(["x", *w[40:74], "y"])]
    assert [r[1] for r in result(spark, texts, 35)] == [35, 35, 0, 0]


def test_least_places():
    rng = np.random.default_rng(0)
    for width in range(1, 20):
        values = rng.integers(0, 5, size=40).astype(np.uint64)
        assert S._least_places(values, width).tolist() == [i + int(values[i : i + width].argmin()) for i in range(40 - width + 1)]
    assert S._least_places(np.zeros(3, np.uint64), 4).tolist() == []


def test_ladder_tells_windows_apart():
    words = np.random.default_rng(1).integers(0, 3, size=3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 3, 18, 35, 64, 100):
        hashes = S.Ladder(words).windows(n)
        assert len(hashes) == 3000 - n + 1
        spelt = [words[i : i + n].tobytes() for i in range(len(hashes))]
        assert len(set(zip(spelt, hashes.tolist(), strict=True))) == len(set(spelt)) == len(set(hashes.tolist()))


def test_runs_hold_every_window_once():
    known = S._WordHashes()
    texts = [[b"a"] * 50, [], [b"b", b"c"] * 30, [str(i).encode() for i in range(34)], [str(i).encode() for i in range(200)]]
    words, n_words = S._hashes(texts, known)
    found = S.runs(words, n_words, 35)
    starts = Counter((int(t), int(s) + k) for t, s, c in zip(found["text"], found["start"], found["count"], strict=True) for k in range(c))
    assert starts == Counter((t, p) for t, w in enumerate(texts) for p in range(len(w) - 34))


def test_worker_caches_may_overflow(spark, monkeypatch):
    monkeypatch.setattr(S, "CACHED", 3)
    known = S._WordHashes()
    words = [b"a", b"b", b"c", b"d", b"a"]
    assert [known[w] for w in words] == [S.xxhash.xxh64_intdigest(w, S.SEED) for w in words] and len(known) <= 3


def test_edges(spark):
    docs = edge_docs(spark)
    got = S.without_repeats(docs, window=5).collect()
    expected = brute([t for _, t, _, _ in EDGES], 5)
    rows = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in got)
    assert rows == sorted((e[0] or -1, *b) for e, b in zip(EDGES, expected, strict=True))
    long = next(r for r in got if r.doc_id == 6)
    assert (long.n_words, long.n_removed, long.kept) == (len(LONG.split()), len(LONG.split()), "")
    assert S.without_repeats(edge_docs(spark, [])).count() == 0
    assert S.repeated_windows(edge_docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        S.repeated_windows(docs, window=0)


def test_a_worker_holds_little(spark):
    """Whole texts come in small batches, and the word hashes that a worker keeps have a bound of tens of MB."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10000")
    try:
        QUERIES["op12_substring_dedup"](spark, SF0001)
        assert int(spark.conf.get(setting)) <= 1000
    finally:
        spark.conf.set(setting, before)
    known = S._WordHashes()
    tracemalloc.start()
    for i in range(1 << 20):
        assert known[b"word-%d" % i] == xxhash.xxh64_intdigest(b"word-%d" % i, S.SEED)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 64 << 20
