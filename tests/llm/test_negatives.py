import random

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm import negatives
from emberlog.llm.negatives import bounds, hard_negatives, hilbert, packed, scores, unpacked


def brute(rows, positives=5, negatives=3, least=50, most=95):
    rows = [(i, label, v) for i, label, v in rows if label is not None and v is not None and all(x is not None for x in v)]
    size = max((len(v) for _, _, v in rows), default=0)
    full = [list(map(int, v)) + [0] * (size - len(v)) for _, _, v in rows]
    out = []
    for a, (ident, label, _) in enumerate(rows):
        if ident is None or ident % 5:
            continue
        s = [sum(x * y for x, y in zip(full[a], f)) for f in full]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-s[i], rows[i][0] is None, rows[i][0] or 0))
        for p in [i for i in order if rows[i][1] == label][:positives]:
            good = [i for i in order if rows[i][1] != label and least * s[p] <= 100 * s[i] <= most * s[p]][:negatives]
            out += [(ident, rows[p][0], r, rows[i][0], s[p], s[i]) for r, i in enumerate(good, 1)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, vec array<bigint>, block string")
    got = hard_negatives(df, "vec_id", F.col("label"), F.col("vec"), F.col("vec_id") % 5 == 0, **more)
    return sorted(map(tuple, got.collect()), key=str)


def test_equal_to_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    centres = [[rng.randrange(-90, 90) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(260):
        centre = rng.choice(centres)
        rows.append((i, rng.randrange(3), [x + rng.randrange(-20, 20) for x in centre]))
    rows += [(1000 + i, 1, centres[0]) for i in range(30)] + [rows[5], rows[5], (2000, None, [1, 2]), (2005, 1, None), (2010, 1, [1, None]), (2015, 2, []), (2020, 0, [50, 60]), (None, 1, centres[1])]
    monkeypatch.setattr(negatives, "BLOCK_BITS", 4)
    monkeypatch.setattr(negatives, "LANE", 4)
    want = brute(rows)
    assert len(want) > 300 and found(spark, rows) == want


def test_large_numbers_and_small_tables(spark):
    rows = [(i, i % 2, [3_000_000_000 - 7 * i, 1, i]) for i in range(12)]
    assert found(spark, [(i, k, [x // 2 for x in v]) for i, k, v in rows]) == brute([(i, k, [x // 2 for x in v]) for i, k, v in rows])
    assert found(spark, []) == [] and found(spark, [(0, 1, [1, 2])]) == []


def test_bounds_hold_and_curve_is_a_path():
    rng = np.random.default_rng(1)
    m, a = rng.integers(-300, 300, (200, 9)), rng.integers(-300, 300, (40, 9))
    below, above = bounds(a, m.min(0)[None], m.max(0)[None])
    s = scores(a, m)
    assert (below[:, 0] <= s.min(1)).all() and (s.max(1) <= above[:, 0]).all()
    assert (unpacked(packed(m), 9) == m).all()
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    place = hilbert(grid, 3)
    assert sorted(place.tolist()) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_blocks_are_ruled_out(spark):
    """Two far apart clusters: an anchor's windows do not read the other cluster's blocks."""
    anchors = spark.createDataFrame([(0, 0, 1, bytearray(packed(np.array([[100, 0]]))), 0, [5000], [9000])], "tile long, at int, label long, vec binary, home long, low array<long>, high array<long>")
    def zone(number, low, high):
        return (number, bytearray(packed(np.array([low]))), bytearray(packed(np.array([high]))), 2, 2)
    zones = spark.createDataFrame([zone(1, [60, 0], [80, 9]), zone(2, [-80, 0], [-60, 9]), zone(3, [95, 0], [99, 1])], "block long, low binary, high binary, least_label long, most_label long")
    got = negatives.wanted_blocks(anchors, zones, 1, 1, 2, False, True).collect()
    assert [r.block for r in got] == [1]
