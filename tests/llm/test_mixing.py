import re

import pytest

from emberlog.llm.mixing import min_cost_flow, mix_sources, repeated, share_out


def weights(names):
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]


def test_share_out():
    assert share_out([10, 10, 10], [5, 2, 1], 3) == pytest.approx([18.75, 7.5, 3.75])
    got = share_out([1, 100, 0, 100], [100, 1, 50, 1], 3)
    assert got == pytest.approx([3, 99, 0, 99]) and sum(got) == pytest.approx(201)
    assert share_out([], [], 3) == [] and share_out([0, 0], [1, 2], 3) == [0.0, 0.0]


def test_flow_prefers_first_copies_and_other_members():
    assert min_cost_flow([(10, [0]), (10, [1]), (10, [0, 1])], [20, 10], 3) == [10, 10, 10]
    assert min_cost_flow([(10, [0]), (5, [0, 1])], [20, 10], 3) == [20, 10] or sum(min_cost_flow([(10, [0]), (5, [0, 1])], [20, 10], 3)) == 30
    assert min_cost_flow([(10, [0])], [100], 3) == [30]
    assert min_cost_flow([(4, [0]), (4, [0])], [12], 3) in ([8, 4], [4, 8], [6, 6])


def test_given_documents_meet_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mix, taken = mix_sources(docs, weights)
    rows = taken.collect()
    texts = {r.doc_id: r for r in docs.collect()}
    by, sizes = {}, {}
    for r in rows:
        d = texts[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) and r.taken == r.size * r.copies and 0 <= r.copies <= 3
        by[d.source] = by.get(d.source, 0) + r.taken
        sizes[d.source] = sizes.get(d.source, 0) + r.size
    assert len(rows) == len(texts) and [n for n, _, _ in mix.sources] == sorted(sizes)
    largest = max(r.size for r in rows)
    for (name, size, target), want in zip(mix.sources, share_out([sizes[n] for n in sorted(sizes)], weights(sizes), 3)):
        assert size == sizes[name] and target == pytest.approx(want) and abs(by[name] - target) <= largest
    again = {r.doc_id: r.taken for r in mix_sources(docs.repartition(5), weights)[1].collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_odd_rows(spark):
    rows = [(1, "a b c", "x", 0), (1, "a b c", "x", 0), (None, "a", None, 1), (3, None, "y", 2), (4, "", "z", 2), (5, "w " * 100, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    mix, taken = mix_sources(docs, weights)
    assert [(n, s) for n, s, _ in mix.sources] == [("x", 106), ("y", 0), ("z", 0), (None, 1)]
    assert taken.count() == 6 and taken.filter("size = 0 and taken > 0").count() == 0
    assert repeated(docs, weights).columns == docs.columns


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i < 30 else ["b", "a"] if i < 60 else ["b"]) for i in range(90)] + [(100, "x", []), (101, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    mix, taken = mix_sources(docs, lambda names: [1.0] * len(names))
    got = {tuple(r.sources): r.taken for r in taken.groupBy("sources").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    assert [n for n, _, _ in mix.sources] == ["a", "b", None] and 880 <= sum(got.values()) <= 920


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    mix, taken = mix_sources(docs, weights)
    assert taken.collect() == [] and mix.sources == [] and repeated(docs, weights).collect() == []


def plain_targets(sizes, weights, limit):
    """The rule as the contract states it: what is above the limit stops there, and the excess goes to the others by weight."""
    full, open_sources = {}, set(range(len(sizes)))
    while open_sources:
        rest, weight = sum(sizes) - sum(full.values()), sum(weights[i] for i in open_sources)
        shares = {i: rest * weights[i] / weight for i in open_sources}
        over = {i for i in open_sources if shares[i] > limit * sizes[i] * (1 + 1e-12)}
        if not over:
            return [full.get(i, shares.get(i)) for i in range(len(sizes))]
        full.update({i: limit * sizes[i] for i in over})
        open_sources -= over
    return [full[i] for i in range(len(sizes))]


def test_targets_follow_the_rule():
    import random
    rng = random.Random(12)
    for _ in range(300):
        n = rng.randrange(1, 9)
        sizes = [rng.choice([0, 1, 7, 100, 5000, 10 ** 6]) * rng.randrange(1, 9) for _ in range(n)]
        if not sum(sizes):
            continue
        w = [(5.0, 2.0, 1.0)[i % 3] for i in range(n)]
        assert share_out(sizes, w, 3) == pytest.approx(plain_targets(sizes, w, 3), rel=1e-9, abs=1e-6)


def test_sources_that_are_no_configuration(spark, monkeypatch):
    from emberlog.llm import mixing
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 5)
    docs = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="combinations of sources"):
        mix_sources(docs, weights)
