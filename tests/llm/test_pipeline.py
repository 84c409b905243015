import hashlib
import random
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from emberlog.llm.inputs import keep_rows
from emberlog.llm.nearcopies import near_copies


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def made(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows, ident = [], 0
    for _ in range(120):
        text = made(rng, rng.randrange(60, 500), vocabulary)
        rows.append((ident, text))
        for edits in ([] if rng.random() < 0.5 else [1, 2, 3]):
            words = text.split()
            for _ in range(edits if len(words) > 150 else 1):
                words[rng.randrange(len(words))] = "changed"
            ident += 1
            rows.append((ident, " ".join(words)))
        ident += 1
    return rows


def test_near_copies_are_found_and_others_left(spark, corpus):
    rows = corpus + [(9000, None), (9001, ""), (9002, "one two"), (9003, "One  two"), (9004, "three")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.group_id, r.kept) for r in near_copies(docs).collect()}
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in combinations(sets, 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in sets}
    assert {i: group for i, (group, _) in got.items()} == want
    assert all(kept == (group == i) for i, (group, kept) in got.items())
    assert near_copies(docs.limit(0)).collect() == []


def test_keep_rows_with_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (None, "c", "z"), (None, None, "z")], "doc_id long, text string, kept string")
    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()
    judged = spark.createDataFrame([(1, sha("a"), True), (1, sha("a"), False), (1, sha("b"), False), (None, sha("c"), True), (None, sha(""), True)], "doc_id long, text_sha256 string, kept boolean")
    assert sorted(map(tuple, keep_rows(docs, judged).collect()), key=str) == sorted([(1, "a", "x"), (None, "c", "z"), (None, None, "z")], key=str)


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use themselves, a dotted one, a struct with a name to be quoted, very long texts, repeated rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row_key string, key int, row int, at int, place int, kept string, _salt int, `a.b` int, s struct<`x y`:int>"
    rest = ("key", 1, 2, 3, 4, "k", 5, 6, (7,))
    long = "long text of few words " * 50_000
    rows = [(i, t, "en", "web", 1, *rest) for i, t in enumerate([long, long + "more", "one two three", "one two three", "some other words here", None, ""])]
    rows += [rows[2], (2, "one two three", "en", "web", 9, *rest)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.schema.names == docs.schema.names, name
        got = out.collect()
        assert got and all(tuple(r)[5:] == rest for r in got), name
    exact = sorted(corpus_pipeline.exact(spark, docs, "").select("doc_id", "n_chars").collect())
    assert [tuple(r) for r in exact] == [(0, 1), (1, 1), (3, 1), (4, 1), (6, 1)]
    near = sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect())
    assert near == [0, 2, 4, 5]


def test_whole_pipeline_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    docs, texts = given, {r.doc_id: r.text for r in given.collect()}
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == given.columns
        docs = spark.createDataFrame(out.collect(), given.schema)
        sizes.append(docs.count())
        if len(sizes) == 2:
            kept = {}
            for r in docs.collect():
                assert r.text not in kept
                kept[r.text] = r.doc_id
            assert all(kept[t] == max(i for i, x in texts.items() if x == t) for t in kept)
        if len(sizes) == 3:
            left = [shingles(r.text) for r in docs.collect()]
            assert not any(similarity(a, b) >= 0.8 for a, b in combinations(left, 2))
    assert sizes[0] >= 0.95 * len(texts) and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] > 0
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    result = corpus_pipeline.run(spark, folder).collect()
    assert len(result) == sizes[3]
    for r in result:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids
