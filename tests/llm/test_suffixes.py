import random
from collections import Counter

import numpy as np
import pytest

from emberlog.llm.suffixes import anchors, common, front_coded, joined, merged, remove_repeated_bytes, whole


def slow(texts, size):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if count[d[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(x for x, g in zip(d, gone) if not g)))
    return out


def made_texts(spark):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()][:90]
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ijé") for _ in range(900))
    around = ["".join(rng.choice("klmnop qrst") for _ in range(rng.randrange(0, 400))) for _ in range(80)]
    texts = given + [a + passage[rng.randrange(0, 300):rng.randrange(400, 900)] + a[::-1] for a in around]
    texts += [None, "", "short", "z" * 1000, "z" * 199, "z" * 200, "ab" * 400, passage[:199], passage[:200], passage[100:301], given[4], given[4] + "!", given[4][:500]]
    return texts + ["x" + passage[:200], passage[350:551] + "y"]


@pytest.mark.parametrize("hot", [{}, {"hot_runs": 2, "hot_here": 2}, {"hot_runs": 10**6, "hot_here": 10**6}])
def test_against_brute_force(spark, hot):
    texts = made_texts(spark)
    docs = spark.createDataFrame([(i if i % 40 else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, run int")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_repeated_bytes(docs.repartition(6), **hot).collect())
    assert got == Counter((i if i % 40 else None, *x) for i, x in enumerate(slow(texts, 200)))


def test_empty(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 10, 199, 200, 201, 70_000, 350)]
    data, ends = joined(texts)
    position, _, first, last = anchors(data, ends, 200)
    starts = np.concatenate([np.arange(f, l + 1) for f, l in zip(first, last)])
    want = np.concatenate([np.arange(e - len(t), e - 199) for t, e in zip(texts, ends) if len(t) >= 200])
    assert starts.tolist() == want.tolist() and (position >= first).all() and (position <= first + 136).all()


def test_front_coding_and_loser_tree():
    rng = random.Random(1)
    every = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    for k in (1, 2, 3, 7, 16):
        runs = []
        for i in range(k):
            entries = sorted(set(every[i::k]))
            lcps, lengths, rests = front_coded(entries)
            assert whole(lcps, lengths, rests) == entries
            runs.append((entries, lcps))
        runs.append(([], []))
        out = list(merged(runs))
        assert [e for e, *_ in out] == sorted(e for r, _ in runs for e in r)
        before = b""
        for entry, lcp, run, i in out:
            assert lcp == common(before, entry, 0) and runs[run][0][i] == entry
            before = entry
