"""Cuts found by counting, against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import ordering as o
from emberlog.operators import outlier as ol
from emberlog.operators import selection as sel

INF = float("inf")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    out = []
    for i in range(3000):
        g = rnd.choice(["hot", "hot", "a", None, "flat"])
        v = {"flat": 2.0, "hot": rnd.choice([rnd.gauss(0, 1e-6), rnd.gauss(5, 100), 7.0, 7.0])}.get(g, rnd.choice([rnd.random(), None, INF, -INF, 1e308, -1e308, 3.0]))
        out.append((g, v, i * 10 ** 13 + rnd.randrange(1000)))
    return out + [("one", 1.0, 5), ("nan", math.nan, 6), ("nan", 4.0, 7), ("nan", None, 8)]


def ascending(rows):
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append((-INF if v is None else v, i))
    return {g: sorted(x) for g, x in groups.items()}


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, v double, i long").repartition(5).cache()


@pytest.mark.parametrize("few", [0, 7, 400, 20_000])
def test_first_rows(spark, rows, table, few, monkeypatch):
    monkeypatch.setattr(sel, "BINS", 16)
    known = [r for r in rows if r[0] != "nan"]
    want = {g: x[:{"hot": 611, "a": 300, None: 1, "flat": 123, "one": 4}.get(g, 0)] for g, x in ascending(known).items()}
    wanted = spark.createDataFrame([("hot", 611), ("a", 300), (None, 1), ("flat", 123), ("one", 4)], "g string, rank long")
    got = sel.first_rows(table.filter("g IS NULL OR g <> 'nan'"), ["g"], F.col("v"), "i", wanted, "flag", few)
    assert got.count() == len(known)
    assert {r.i for r in got.filter("flag = 1").collect()} == {i for x in want.values() for _, i in x}


@pytest.mark.parametrize("few", [0, 50, 20_000])
def test_values_at_a_rank(spark, rows, table, few):
    known = ascending([r for r in rows if r[0] in ("hot", "flat", "one")])
    for rank in (1, 2, 400, 1100):
        wanted = spark.createDataFrame([(g, rank) for g in known], "g string, rank long")
        got = {r.g: (r.value, r.next) for r in sel.values_at(table, ["g"], "v", wanted, few).collect()}
        assert got == {g: (x[rank - 1][0], x[rank][0] if rank < len(x) else None) for g, x in known.items() if rank <= len(x)}


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_shares_and_first_by_score(spark, rows, table, hot_rows):
    def falling(r):
        v = r[1]
        return (INF if v is None else -INF if math.isnan(v) else -v, r[2])
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    flagged = {r.i for r in o.top_share(table.filter("g IS NOT NULL"), ["g"], "v", "i", 0.1, "flag", hot_rows).filter("flag = 1").collect()}
    assert flagged == {r[2] for g, x in groups.items() if g for r in sorted(x, key=falling)[:max(1, len(x) // 10)]}
    first = {r.i for r in o.first_by_score(table, ["g"], "v", "i", 150, hot_rows).collect()}
    assert first == {r[2] for x in groups.values() for r in sorted(x, key=falling)[:150]}


def test_quantile_of_a_large_group(spark, rows, table):
    df = table.filter("g IN ('hot', 'flat', 'one')").withColumnRenamed("v", "_factor").withColumnRenamed("i", "row_id")
    small, large = (sorted((r.row_id, r.lof_label) for r in ol.label_by_quantile(df, ["g"], 0.07, hot_rows=hot).collect()) for hot in (None, 10))
    assert small == large and sum(x for _, x in small) < len(small)


def test_cuts_meet_rows_without_laying_them_out(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000).cast("double").alias("v"), F.col("id").alias("i"))
    plan = o.top_share(df, ["g"], "v", "i", 0.1, "top", hot_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
