"""Neighbours and outlier factor against brute force, with copies, zeros and small groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import neighbors as nb
from emberlog.operators import outlier as ol


@pytest.fixture(scope="module")
def groups():
    rnd = np.random.default_rng(4)
    big = rnd.normal(size=(150, 4)) + rnd.integers(0, 4, size=(150, 1)) * 4
    dup = np.repeat(rnd.normal(size=(12, 4)), [1, 9, 2, 1, 1, 7, 1, 1, 3, 1, 1, 1], axis=0)
    zeros = np.vstack([np.zeros((3, 4)), rnd.normal(size=(9, 4))])
    return {"big": big, "dup": dup, "zeros": zeros, "one": rnd.normal(size=(1, 4)), "two": rnd.normal(size=(2, 4)), "same": np.ones((6, 4))}


def frame(spark, groups):
    rows, i = [], 0
    for g, m in groups.items():
        for v in m:
            rows.append((i, g, [float(x) for x in v]))
            i += 1
    return spark.createDataFrame(rows, "row_id long, source_file string, embedding array<double>").repartition(5), rows


def knn_model(m, k):
    n = len(m)
    if n < 2:
        return [0.0] * n
    k = min(k, n - 1)
    norm = np.linalg.norm(m, axis=1)
    unit = m / np.where(norm > 0, norm, 1)[:, None]
    d = 1 - unit @ unit.T
    for i in range(n):
        if norm[i] > 0:
            d[i, i] = 0
    return np.sort(d, axis=1)[:, :k].mean(axis=1)


def lof_model(m, k):
    n = len(m)
    if n < 2:
        return [0.0] * n
    k = min(k, n - 1)
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    # Equal vectors are interchangeable; among different ones at equal distance the first wins.
    order = [sorted((j for j in range(n) if j != i), key=lambda j: (round(d[i, j], 12), j))[:k] for i in range(n)]
    kd = np.array([d[i, o[-1]] for i, o in enumerate(order)])
    lrd = np.array([1 / (np.mean([max(kd[j], d[i, j]) for j in o]) + 1e-10) for i, o in enumerate(order)])
    return [-np.mean([lrd[j] for j in o]) / lrd[i] for i, o in enumerate(order)]


@pytest.mark.parametrize("block", [4096, 16])
def test_knn_score(spark, groups, block, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", block)
    df, rows = frame(spark, groups)
    got = {r.row_id: r.anomaly_score for r in nb.knn_score(df).collect()}
    assert len(got) == len(rows)
    want = [x for m in groups.values() for x in knn_model(m, 5)]
    assert np.allclose([got[i] for i in range(len(rows))], want, atol=1e-9)


@pytest.mark.parametrize("block", [4096, 16])
def test_lof_factor(spark, groups, block, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", block)
    df, rows = frame(spark, groups)
    got = {r.row_id: r.f for r in ol.lof_factor(df, k=5, name="f").collect()}
    want = [x for m in groups.values() for x in lof_model(m, 5)]
    assert np.allclose([got[i] for i in range(len(rows))], want, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_contamination_quantile(spark, groups, hot_rows):
    df, rows = frame(spark, {"big": groups["big"], "one": groups["one"]})
    got = ol.lof_label(df, k=5, contamination=0.1, hot_rows=hot_rows).collect()
    scores = -np.array(lof_model(groups["big"], 5))
    cut = np.percentile(-scores, 10)
    assert {r.row_id for r in got if r.lof_label == -1} == {i for i in range(150) if -scores[i] < cut}
    assert [(r.lof_label, r.lof_score) for r in got if r.source_file == "one"] == [(1, 0.0)]


def test_approximate_search_is_close(spark, groups, monkeypatch):
    df, rows = frame(spark, {"big": groups["big"]})
    want = np.array(knn_model(groups["big"], 5))
    got = {r.row_id: r.anomaly_score for r in nb.knn_score_approx(df, probe=4, pivots=10).collect()}
    mine = np.array([got[i] for i in range(len(rows))])
    assert np.all(mine >= want - 1e-9) and np.mean(np.abs(mine - want) < 1e-9) > 0.8
    all_cells = {r.row_id: r.anomaly_score for r in nb.knn_score_approx(df, probe=10, pivots=10).collect()}
    assert np.allclose([all_cells[i] for i in range(len(rows))], want, atol=1e-9)


def test_sample_features(spark):
    data = [[0.4, 2.0, 0.6], [0.5, 2.1, 0.5], [0.6, 1.9, 0.6], [0.4, 2.0, 0.4], [0.5, 2.2, 0.6], [9.0, 0.1, 7.0]]
    df = spark.createDataFrame([(i, "f", v) for i, v in enumerate(data)], "row_id long, source_file string, embedding array<double>")
    got = [r.negative_factor for r in ol.lof_scores(df, k=3).orderBy("row_id").collect()]
    assert len(got) == 6 and all(s <= 0 for s in got) and got[5] < np.mean(got[:5])


LOGS = ["ERROR: ledger write rejected by replica two", "INFO: parcel 7 left the depot", "ERROR: ledger write rejected by replica nine",
        "WARN: belt three runs hot", "INFO: shift plan published", "ERROR: ledger write rejected by replica two",
        "INFO: parcel 7 reached the shop", "ERROR: printer queue lost its spooler"]


def test_mark_lof_on_text(spark):
    df = spark.createDataFrame([(i, "f", x) for i, x in enumerate(LOGS)], "row_id long, source_file string, log string")
    out = ol.mark_lof(df, threshold=-1.5, size=10)
    rows = out.collect()
    assert dict(out.dtypes)["is_lof_anomaly"] == "boolean"
    assert len(rows) == 8 and all(r.lof_score is not None for r in rows)


def test_neighbor_lists(spark, groups):
    df, _ = frame(spark, {"dup": groups["dup"]})
    near = nb.neighbor_pairs(df, ["source_file"], 3)
    assert near.count() == 12 * 3
    assert near.filter((F.col("vid") == F.col("neighbor")) & (F.col("distance") < 1e-12)).count() == 12


def test_nearest_in_lanes(spark, groups, monkeypatch):
    """Distances are held for a few rows at a time; what is found does not change with how many."""
    from emberlog.operators import cells, distances as ds
    rnd = np.random.default_rng(2)
    ask, offer = rnd.normal(size=(300, 5)), rnd.normal(size=(1500, 5))
    whole, near = np.sort(ds.closest(ask, offer, 9), axis=1), np.sort(cells.close_rows(ask, offer, 5, 0.98), axis=1)
    held = []
    plain = ds.squared
    monkeypatch.setattr(ds, "squared", lambda a, b: held.append(len(a) * len(b)) or plain(a, b))
    monkeypatch.setattr(ds, "HELD", 6000)
    assert (np.sort(ds.closest(ask, offer, 9), axis=1) == whole).all() and max(held) <= 6000
    monkeypatch.setattr(cells, "HELD", 200)
    assert (np.sort(cells.close_rows(ask, offer, 5, 0.98), axis=1) == near).all()


def test_rows_of_one_vector_stay_where_they_are(spark):
    """All rows of a file have one vector: they meet its score without coming together in one task."""
    rows = spark.createDataFrame([(i, "f", [1.0, 2.0]) for i in range(500)], "row_id long, source_file string, embedding array<double>")
    plan = nb.knn_score(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
