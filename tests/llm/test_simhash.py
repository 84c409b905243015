import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from emberlog.llm.components import components
from emberlog.llm.simhash import fingerprint, near_links, simhash_groups


def slow_fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in combinations(range(len(fps)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", "  \t", "One", "one Two", "a b c", "a\x0bb\x0cc d d d d", "É é x y Z \x85 q\xa0r", "w " * 500])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_groups_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, "x") for r in rows] + [(900, None, None), (901, "", None), (902, " \n", None), (903, "Lone", "y"), (904, rows[5].text.upper(), "z"), (904, rows[5].text.upper(), "z")]
    rows += [(1000 + i, rows[7][1] + " tail" * i, "near") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()}
    rows = sorted(set(rows), key=lambda r: r[0])
    fps = [slow_fingerprint(r[1] or "") for r in rows]
    assert got == {r[0]: (f"{f:016x}", rows[c][0]) for r, f, c in zip(rows, fps, slow_components(fps))}


def test_links_of_long_lists_are_all_found(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = {int(base[0])}
    for b in base:
        for _ in range(700):
            flips = rng.choice(14 if rng.random() < 0.5 else 64, rng.integers(1, 5), replace=False)
            fps.add(int(b) ^ sum(1 << int(i) for i in flips))
    fps = np.array(sorted(fps), np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {tuple(sorted((r.u, r.v))) for r in near_links(nodes).collect()}
    bits = np.bitwise_count(fps[:, None] ^ fps[None, :])
    a, b = np.nonzero(np.triu(bits <= 2, 1))
    want = {tuple(sorted((int(x), int(y)))) for x, y in zip(fps.view(np.int64)[a], fps.view(np.int64)[b])}
    assert got == want and len(want) > 5000


def test_components_of_chain_star_and_loop(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299), (299, 300), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 299: 299, 300: 299}


def test_empty(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
