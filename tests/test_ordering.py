import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import ordering as o


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    # One group holds a third of all rows; values repeat.
    return [(("hot" if i % 3 == 0 else f"g{rnd.randrange(9)}"), rnd.randrange(40), i, rnd.randrange(-3, 7)) for i in range(900)]


def expected_totals(rows):
    out, state = {}, {}
    for g, at, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, s = state.get(g, (0, 0))
        state[g] = (n + 1, s + v)
        out[i] = state[g]
    return out


@pytest.mark.parametrize("hot_rows", [None, 1_000_000, 100, 1])
def test_running_totals(spark, rows, hot_rows):
    df = spark.createDataFrame(rows, "g string, at int, i int, v int").repartition(7)
    got = o.running_totals(df, ["g"], ["at", "i"], {"n": F.lit(1), "s": F.col("v")}, hot_rows).collect()
    assert {r.i: (r.n, r.s) for r in got} == expected_totals(rows)


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_one_global_group_and_null_keys(spark, rows, hot_rows):
    df = spark.createDataFrame([(None if g == "hot" else g, at, i, v) for g, at, i, v in rows], "g string, at int, i int, v int")
    n = o.number_rows(df, [], ["at", "i"], "n", hot_rows).agg(F.max("n"), F.countDistinct("n")).first()
    assert tuple(n) == (900, 900)
    by_null = o.number_rows(df, ["g"], ["at", "i"], "n", hot_rows).filter("g IS NULL").agg(F.max("n"), F.count("*")).first()
    assert tuple(by_null) == (300, 300)


def test_top_rows_large_and_small(spark, rows):
    df = spark.createDataFrame(rows, "g string, at int, i int, v int").repartition(9)
    for n in (2, 120):
        got = o.top_rows(df, ["g"], [F.col("v").desc(), "i"], n).collect()
        want = []
        for g in {r[0] for r in rows}:
            want += sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[2]))[:n]
        assert sorted(r.i for r in got) == sorted(w[2] for w in want)


@pytest.mark.parametrize("hot_rows", [None, 60])
def test_top_share_at_least_one(spark, rows, hot_rows):
    df = spark.createDataFrame([*rows, ("single", 1, 9999, 1)], "g string, at int, i int, v int")
    flagged = {r.g: r.n for r in o.top_share(df, ["g"], "v", "i", 0.05, "flag", hot_rows)
               .filter("flag = 1").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert flagged["single"] == 1
    assert flagged["hot"] == 15


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
@pytest.mark.parametrize("with_self", [True, False])
def test_around_is_independent_of_block_size(spark, block, with_self):
    data = [(g, i, f"{g}{i}") for g in "ab" for i in range(1, 24)]
    df = spark.createDataFrame(data, "g string, line_no long, log string")
    got = o.around(df, ["g"], "line_no", F.col("log"), "near", 5, 5, with_self, block).collect()
    assert len(got) == len(data)
    for r in got:
        want = [f"{r.g}{j}" for j in range(max(1, r.line_no - 5), min(23, r.line_no + 5) + 1) if with_self or j != r.line_no]
        assert r.near == want


@pytest.mark.parametrize("hot_rows", [None, 20, 1])
def test_the_rows_beside(spark, rows, hot_rows):
    """Values before and after a row, null values included, within slices of a hot group and across their edges."""
    rows = [(None if g == "g1" else g, at, i, None if v == 0 else v) for g, at, i, v in rows]
    df = spark.createDataFrame(rows, "g string, at int, i int, v int").repartition(7)
    got = o.beside(df, ["g"], ["at", "i"], {"was": F.col("v")}, {"next": F.col("i"), "then": F.col("v")}, hot_rows).collect()
    want = {}
    for group in {r[0] for r in rows}:
        line = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2]))
        for n, r in enumerate(line):
            after = line[n + 1] if n + 1 < len(line) else (None,) * 4
            want[r[2]] = (line[n - 1][3] if n else None, after[2], after[3])
    assert {r.i: (r.was, r.next, r.then) for r in got} == want
