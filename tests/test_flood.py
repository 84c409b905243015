"""Flood blocks against the plain greedy scan."""

import random

import pytest

from emberlog.operators import flood as fl

NAMES = ["a b c d e f g h i j", "a b c d e f g h i x", "a b q r s t u v w z", "disk full", ""]


def alike(x, y):
    x, y = set(x.split()), set(y.split())
    return len(x & y) / len(x | y) if x | y else 0


def greedy(templates, window, threshold):
    n, at, out = len(templates), 0, []
    if n <= window:
        return out
    while at < n:
        part = templates[at: at + window]
        top = max(dict.fromkeys(part), key=part.count)
        if part.count(top) / window >= threshold:
            end = at + window
            while end < n and alike(templates[end], top) > 0.8:
                end += 1
            out.append((at + 1, min(end, n), top))
            at = end
        else:
            at += 1
    return out


@pytest.fixture(scope="module")
def files():
    rnd = random.Random(5)
    out = {}
    for f in range(70):
        rows, n = [], rnd.randrange(3, 70)
        while len(rows) < n:
            kind = rnd.choice(NAMES)
            for _ in range(rnd.randrange(1, 16)):
                rows.append(kind if rnd.random() < 0.85 else rnd.choice(NAMES))
        out[f"f{f}"] = rows[:n]
    out["whole"] = [NAMES[0]] * 50
    out["tail"] = [NAMES[3], NAMES[2]] * 10 + [NAMES[0]] * 7
    out["short"] = [NAMES[0]] * 8
    return out


def frame(spark, files):
    rows = [(f, i + 1, t, f"ERROR {t} n{i}" if i % 2 else f"warn {t}", i) for f, ts in files.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "source_file string, line_no long, log_template string, log string, row_id long").repartition(6)


@pytest.mark.parametrize("window,threshold,hot_rows,chunk", [
    (8, 0.75, None, 1_000_000), (8, 0.75, 10, 8), (5, 0.6, None, 5), (5, 0.6, 10, 13), (10, 1.0, None, 11), (3, 0.6, None, 4),
    (8, 0.5, None, 1_000_000), (8, 0.4, 10, 8), (10, 0.3, None, 13), (6, 0.2, None, 7)])
def test_blocks_equal_the_scan(spark, files, window, threshold, hot_rows, chunk):
    got = {}
    for r in fl.flood_blocks(frame(spark, files), window, threshold, hot_rows, chunk).collect():
        got.setdefault(r.source_file, []).append((r.block_start, r.block_end, r.dominant))
    for f, templates in files.items():
        assert sorted(got.get(f, [])) == greedy(templates, window, threshold), f


def test_summary_rows(spark, files):
    df = frame(spark, {k: files[k] for k in ("whole", "short")})
    out = fl.collapse_floods(df, 8, 0.75).collect()
    assert len([r for r in out if r.source_file == "short"]) == 8
    flood, = [r for r in out if r.source_file == "whole"]
    assert flood.is_flood and flood.flood_count == 50 and flood.is_anomaly == 1
    assert flood.log == f"[LOG FLOOD] 50 occurrences of similar logs: {NAMES[0]}"
    assert flood.flood_info.severity == "error" and flood.flood_info.components == ["ERROR", "warn"]


def test_variable_parts_in_first_seen_order(spark):
    rows = [("f", i + 1, "job <*> done", f"job {n} done", i) for i, n in enumerate([7, 3, 7, 5])] + [("f", 5, "job <*> done", "job 9 done now", 4)]
    df = spark.createDataFrame(rows, "source_file string, line_no long, log_template string, log string, row_id long")
    got = fl.flood_patterns(df.selectExpr("*", "1L AS block_start")).first()
    assert got.variable_parts == ["7", "3", "5"] and got.severity == "unknown" and got.components == ["job"]


def test_similarity_is_strict_and_complete(spark):
    rnd = random.Random(2)
    names = list({" ".join(rnd.sample("abcdefghijkl", rnd.randrange(1, 12))) for _ in range(120)} | {""})
    df = spark.createDataFrame([("f", n) for n in names], "source_file string, template string")
    got = {(r.dominant, r.template) for r in fl.similar_templates(df.withColumnRenamed("template", "dominant"), df).collect()}
    assert got == {(x, y) for x in names for y in names if alike(x, y) > 0.8}


def test_threshold_must_be_a_share(spark, files):
    with pytest.raises(ValueError):
        fl.flood_blocks(frame(spark, files), 8, 0.0)


def test_templates_with_a_word_in_common_are_not_all_compared(spark):
    """Two thousand templates share the wildcard; candidates stay near the number of true pairs."""
    names = [f"<*> kind{i} part{i} step{i} done{i}" for i in range(2000)]
    right = spark.createDataFrame([("f", n) for n in names] + [("f", names[7] + " more")], "source_file string, template string")
    left = right.withColumnRenamed("template", "dominant")
    assert fl.candidate_templates(left, right).count() < 3 * 2003
    assert fl.similar_templates(left, right).count() == 2003


def test_a_file_of_a_thousand_chunks(spark, monkeypatch):
    """The chain over the chunks is composed level by level: with four blocks to a level, five levels."""
    monkeypatch.setattr(fl, "CHAIN", 4)
    rnd = random.Random(9)
    rows = []
    while len(rows) < 5000:
        kind = rnd.choice(NAMES[:4])
        rows += [kind if rnd.random() < 0.9 else rnd.choice(NAMES) for _ in range(rnd.randrange(1, 40))]
    files = {"long": rows, "other": rows[1000:1700], "calm": NAMES[2:4] * 30}
    got = {}
    for r in fl.flood_blocks(frame(spark, files), 5, 0.8, None, 5).collect():
        got.setdefault(r.source_file, []).append((r.block_start, r.block_end, r.dominant))
    for f, templates in files.items():
        assert sorted(got.get(f, [])) == greedy(templates, 5, 0.8), f
    assert len(got["long"]) > 100


def test_blocks_know_the_ways_through(spark):
    import pandas as pd
    rnd = random.Random(4)
    size = 10
    moves = {(n, i): rnd.randrange((n + 1) * size + 1, (n + 3) * size) for n in range(6) if n != 2 for i in {n * size + 1, n * size + 4, n * size + 7}}
    moves = {k: v for k, v in moves.items()}
    pdf = pd.DataFrame([(n, i, o) for (n, i), o in moves.items()], columns=["block", "line_in", "line_out"])
    chain = fl._Moves(pdf, size)
    out = chain.ways_out(size)
    for (n, i) in moves:
        path = chain.path(i, size)
        assert path[0] == (n, i) and out[i] == moves[path[-1]]
