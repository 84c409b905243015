import hashlib

import numpy as np
import pytest

from emberlog.llm.sketch import LEAST, containment, fingerprints, likeness, merge, neighbour_fingerprints, parsed, sketch, spelled


def shingles(text):
    return {text[i:i + 8] for i in range(max(1, len(text) - 7))} if text else set()


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (ident, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((ident, len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_texts(spark, parts):
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = given + [(None, "no id"), (None, "none"), (-5, None), (10**12, ""), (7, "tie"), (7, "a tie"), (7, "tie"), (500, "é" * 9 + "漢字🙂" * 5)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string").repartition(parts)
    got = neighbour_fingerprints(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 1500]
    assert abs(np.mean([r.near_edited for r in long]) - 1 / 3) < 0.06 and np.mean([r.near_next for r in long]) < 0.1


def test_single_row_and_none(spark):
    one = neighbour_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert neighbour_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimates():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(9000)]
    book, page = " ".join(words), " ".join(words[4000:4300])
    for a, b in ((book, " ".join(words[:6000])), (page, book), (book, page), (page, " ".join(words[4200:4500]))):
        x, y = shingles(a), shingles(b)
        assert likeness(sketch(a), sketch(b)) == pytest.approx(len(x & y) / len(x | y), abs=0.06)
        assert containment(sketch(a), sketch(b)) == pytest.approx(len(x & y) / len(x), abs=0.08)
    assert (merge(sketch(book[:30000]), sketch(book[29993:])) == sketch(book)).all()


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abcdefgh", "x" * 1000, "some short text", "é漢字🙂" * 40, "w" * 200_000 + "end"])
def test_small_texts(text):
    made = sketch(text)
    assert (parsed(spelled(made)) == made).all() and likeness(made, made) == 1.0
    assert len(made) == len(shingles(text)) if len(shingles(text)) < LEAST else len(made) >= LEAST


def test_equal_texts_equal_fingerprints(spark):
    docs = spark.createDataFrame([(1, "same text here"), (2, "same text here"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    assert got[1] == got[2] and got[3] == got[4] == ""
