import random
from itertools import combinations

import numpy as np
import pytest

from emberlog.llm import setjoin
from emberlog.llm.setjoin import jaccard_components, shingle_sets, signatures, sketch, sketch_pairs, sketches_allow, smallest_safe


def shingles(text, n=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= round(100 * similarity) * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return sorted(((ident, len(s), least.get(find(i))) for i, ((ident, _), s) in enumerate(zip(rows, sets))), key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, `a.b` int")
    return sorted(map(tuple, jaccard_components(docs, **more).collect()), key=str)


def made(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


ODD = [(None, "null identifier of its own words here"), (9000, None), (9001, ""), (9002, " \t\n"), (9003, "One two"), (9004, "one  TWO"), (9005, "three"),
       (9006, "ÄÖ x"), (9007, "äö x"), (9008, "a b c d e f g"), (9008, "a b c d e f g"), (9009, "w " * 30_000), (9010, "w " * 20_000)]


def test_texts_near_the_threshold(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(60):
        text = made(rng, rng.randrange(5, 400), vocabulary)
        rows.append((len(rows), text))
        for _ in range(rng.randrange(4)):
            rows.append((len(rows), edited(rng, text, max(1, int(len(text.split()) * rng.choice([0.01, 0.02, 0.025, 0.03]))))))
    rows += ODD
    want = brute(rows)
    assert len({w[2] for w in want}) < len(rows) - 20 and found(spark, rows) == want


def test_shared_passages_and_a_large_group(spark, monkeypatch):
    """Frequent members are indexed in pairs and threes: every class is met, and long lists with several components."""
    monkeypatch.setattr(setjoin, "FEW", 2)
    monkeypatch.setattr(setjoin, "MANY", 4)
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    rng = random.Random(6)
    passages = [made(rng, 40, [f"p{i}" for i in range(5000)]) for _ in range(12)]
    rows = [(i, " ".join(rng.sample(passages, 8))) for i in range(150)]
    base = made(rng, 300, [f"b{i}" for i in range(5000)])
    rows += [(1000 + i, edited(rng, base, rng.randrange(1, 12))) for i in range(120)]
    rows += [(2000 + i, " ".join(rng.sample(passages, 10)) + " " + made(rng, 20, [f"x{i}" for i in range(900)])) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert found(spark, []) == [] and found(spark, [(4, "x")]) == [(4, 1, 4)] and found(spark, [(1, None)]) == [(1, 0, 1)]
    with pytest.raises(ValueError):
        found(spark, [(1, "a b")], similarity=0.4)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for similarity in (0.6, 0.8, 0.9):
        safe = smallest_safe(similarity)
        universe = rng.integers(0, 2**63, 400).astype(np.uint64)
        power = dict(zip(universe.tolist(), rng.integers(1, 14, 400).tolist()))
        checked = 0
        for _ in range(400):
            n = int(rng.integers(1, 60))
            a = rng.choice(universe, n, replace=False)
            cut = int(rng.integers(0, n // 3 + 1))
            b = np.unique(np.concatenate([a[cut:], rng.choice(universe, int(rng.integers(0, 4)), replace=False)]))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if not len(b) or common < similarity * (len(a) + len(b) - common) - 1e-9:
                continue
            checked += 1
            keys = [signatures(x, np.array([power[h] for h in x.tolist()]), similarity, safe) for x in (a, b)]
            assert len(np.intersect1d(*keys)) or (len(a) == len(b) == common)
        assert checked > 60


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 60, 64, 70, 500)]
    sets += [np.unique(np.r_[s[: max(1, int(len(s) * 0.92))], rng.integers(0, 2**63, len(s) // 20).astype(np.uint64)]) for s in sets]
    sketches = [sketch(s) for s in sets]
    for i, j in combinations(range(len(sets)), 2):
        if setjoin.set_similarity(sets[i], sets[j]) >= 0.8:
            assert sketches_allow(sketches[i], len(sets[i]), sketches[j], len(sets[j]), 0.8)
    node, n = np.arange(len(sets)), np.array([len(s) for s in sets])
    def sized(i, j):
        return min(n[i], n[j]) >= 0.8 * max(n[i], n[j])
    i, j, _ = sketch_pairs(node, n, node, np.zeros(len(sets), int), sketches, 0.8)
    pairs = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist()) if sized(*p)}
    assert pairs == {(i, j) for i, j in combinations(range(len(sets)), 2) if sized(i, j) and sketches_allow(sketches[i], n[i], sketches[j], n[j], 0.8)}


def test_shingles_of_bytes():
    assert [len(s) for s in shingle_sets([b"", b"a b", b"a b c d e", b"a b c d e f", b"A B c d E"], 5)] == [0, 1, 1, 2, 1]
    a, b, c = shingle_sets([b"one TWO", b"ONE\ttwo", b"one two three four five"], 5)
    assert a.tolist() == b.tolist() != c.tolist()


def test_best_pairs_of_components():
    found = setjoin._Found(best=True)
    u, v = np.array([1, 5, 2, 9]), np.array([2, 1, 7, 8])
    part = {1: 10, 2: 20, 5: 50, 7: 70, 8: 80, 9: 10}
    parts = [np.array([part[x] for x in side.tolist()]) for side in (u, v)]
    found.add(u, v, *parts, np.array([0.05, 0.02, 0.01, 0.09]))
    assert found.reduce().tolist() == [[1, 5], [2, 7], [8, 9]]
