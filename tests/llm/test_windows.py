import re
from collections import Counter

import numpy as np
import pytest

from emberlog.llm.runs import pack, shared, spans_of, unpack
from emberlog.llm.windows import remove_repeated_windows, word_hashes


def slow(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    count = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i:i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("size", [3, 35])
def test_against_brute_force(spark, size):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = given + [None, "", " \n ", "a " * 200, "b b", "\x85one\xa0two three\x0bfour", given[3] + " end", given[3], given[3][:40]] + ["the same passage of many words again and again " * 5 + str(i) for i in range(30)]
    docs = spark.createDataFrame([(i if i % 50 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, run int")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(docs.repartition(7), size=size).collect())
    assert got == Counter((i if i % 50 else None, *x) for i, x in enumerate(slow(texts, size)))


def test_a_word_longer_than_a_piece():
    long = b"x" * 700_000
    start, hashes = word_hashes(b"a " + long + b" b " + long + b" a")
    assert start.tolist() == [0, 2, 700_003, 700_005, 1_400_006] and hashes[1] == hashes[3] and hashes[0] == hashes[4] and len(set(hashes.tolist())) == 3


def test_empty(spark):
    assert remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pack():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 500):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        assert (unpack(pack(a)) == a).all()
    assert (unpack(pack(np.array([0, 2**64 - 1], np.uint64))) == np.array([0, 2**64 - 1], np.uint64)).all()


def test_shared():
    lists = [np.array(x, np.uint64) for x in ([1, 2, 3], [], [2, 5], [3, 9])]
    assert [x.tolist() for x in shared(lists)] == [[2, 3], [], [2], [3]]


def test_spans():
    assert spans_of(np.array([0, 1, 5, 9, 20]), 4) == [(0, 13), (20, 24)]
