import random
from collections import Counter

import numpy as np
import xxhash

from conftest import SF0001
from llm_fixture import EDGES, edge_docs
from pdcspark.llm import simhash
from pdcspark.llm.queries import QUERIES


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, bits=2):
    """rows of (id, fingerprint) -> the least id reachable from each."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            r = find(i)
            least[r] = min(x, least.get(r, x))
    return [least.get(find(i)) for i in range(len(rows))]


def test_golay_is_perfect_and_keys_cover_two_bits():
    _, errors = simhash._golay()
    assert (np.array([int(e).bit_count() for e in errors[:, 0]]) <= 3).all()
    assert sorted(Counter((errors >= 0).sum(axis=1)).items()) == [(1, 277), (6, 1771)]
    rnd = random.Random(1)
    a = [rnd.getrandbits(64) for _ in range(1500)]
    b = [x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for x in a]
    keys = [simhash.keys_of(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
    for x, y in zip(*keys, strict=True):
        assert set(x[x >= 0]) & set(y[y >= 0])


def links_of(spark, fps, **options):
    signed = [(int(np.array(f, np.uint64).view(np.int64)),) for f in fps]
    from pdcspark.llm.components import components

    found = components(simhash.links(spark.createDataFrame(signed, "fp long"), **options)).collect()
    root = {r.node: r.root for r in found}
    return [root.get(f, f) for (f,) in signed]


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def test_links_against_brute_force(spark):
    """Chains, stars and a crowd around one fingerprint, with and without the midpoint way."""
    rnd = random.Random(2)
    fps, at = set(), rnd.getrandbits(64)
    for _ in range(40):  # a chain of steps of two bits
        at ^= (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
        fps.add(at)
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(0, 64, 9)}
    fps |= {rnd.getrandbits(64) for _ in range(60)} | {0, 1, 7, (1 << 64) - 1, 1 << 63}
    fps = sorted(fps)
    for bits, few in ((2, 32), (2, 1), (1, 1), (0, 32)):
        want = brute_groups(list(zip(range(len(fps)), fps, strict=True)), bits)
        assert same_partition(links_of(spark, fps, max_bits=bits, pairs_up_to=few), want), (bits, few)


def test_edges(spark):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(edge_docs(spark)).collect())
    rows = [(i, brute_fingerprint(t)) for i, t, _, _ in EDGES]
    want = Counter((i, f"{f:016x}", g) for (i, f), g in zip(rows, brute_groups(rows), strict=True))
    assert got == want
    assert simhash.near_duplicates(edge_docs(spark, [])).count() == 0


def test_keep_one(spark):
    docs = edge_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(i, brute_fingerprint(t)) for i, t, _, _ in EDGES]
    groups = brute_groups(rows)
    got = [(r.doc_id, brute_fingerprint(r.text)) for r in kept.collect()]
    assert len(got) == len({g if g is not None else ("none", f) for (_, f), g in zip(rows, groups, strict=True)})
    assert {g for g in groups if g is not None} <= {i for i, _ in got}
    assert simhash.keep_one(edge_docs(spark, [])).count() == 0


def test_op8_against_brute_force(spark):
    texts = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash_dedup"](spark, SF0001).collect()}
    assert got == {i: (f"{f:016x}", g) for (i, f), g in zip(texts, brute_groups(texts), strict=True)}
