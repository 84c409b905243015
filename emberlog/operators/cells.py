"""Approximate nearest neighbours: an index of cells in cells that is as careful as the data need.

Coarse cells, about as many as the root of a group's vectors over ``CELL``, are built around sampled vectors. A vector looks
into several of them, in the order of the distance to their border (half way to the cell's centre), not to the centre. Within
a coarse cell the vectors are cut into fine cells of about ``CELL`` vectors by the task that holds it, and the task looks into
some of these in the same order. So a vector is compared with a number of others that does not depend on how many there are.

How many cells are enough is measured: for a bounded sample of vectors (``SAMPLE`` of each group, ``TRIED`` of each task) the
true neighbours are found by comparison with everything, and the cells that hold the wanted share of them are looked into by
all. Where vectors have a structure these are few; where they have none, all, and the search is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.distances import HELD, best_of_blocks, closest, distances, fields, matrix, near_fields, squared
from emberlog.operators.ordering import top_rows
from emberlog.session import cut_lineage

CELL = 64
SAMPLE = 256
TRIED = 96
WHOLE = 1024
LANE = 4096
PART = 8192
SPARE = 4


def border(to_centres: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Distance of every row to the border of each cell, from squared distances to the centres and distances between centres."""
    own = to_centres.argmin(axis=1)
    gap = gaps[own]
    return np.where(gap > 0, (to_centres - to_centres[np.arange(len(own)), own][:, None]) / (2 * np.where(gap > 0, gap, 1)), 0.0)


def _centres(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cell of every point): evenly picked points, moved once to the mean of what is nearest."""
    centres = points[np.linspace(0, len(points) - 1, cells).astype(int)]
    own = squared(points, centres).argmin(axis=1)
    sums, counts = np.zeros_like(centres), np.bincount(own, minlength=cells)
    np.add.at(sums, own, points)
    centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres, squared(points, centres).argmin(axis=1)


def close_rows(ask: np.ndarray, offer: np.ndarray, k: int, share: float) -> np.ndarray:
    """For every row of ``ask`` at least ``k`` row numbers of ``offer`` (-1: none), among them about ``share`` of its ``k`` nearest."""
    take = min(k + SPARE, len(offer))
    if len(offer) <= WHOLE:
        return closest(ask, offer, take)
    cells = -(-len(offer) // CELL)
    centres, own = _centres(offer, cells)
    to_border = border(squared(ask, centres), distances(centres, centres))
    tried = np.unique(np.linspace(0, len(ask) - 1, TRIED).astype(int))
    true = closest(ask[tried], offer, take)
    exact = ((ask[tried][:, None, :] - offer[true]) ** 2).sum(axis=2)
    true = np.take_along_axis(true, np.argsort(exact, axis=1)[:, :min(k, take)], axis=1)
    order = to_border[tried].argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    ranks = np.sort(np.take_along_axis(order, own[true], axis=1).ravel())
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))))]) + 1
    if 2 * probes >= cells:
        return closest(ask, offer, take)
    chosen = np.argpartition(to_border, probes - 1, axis=1)[:, :probes]
    by_cell = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[by_cell], np.arange(cells + 1))
    asked = np.argsort(chosen.ravel(), kind="stable")
    ends = np.searchsorted(chosen.ravel()[asked], np.arange(cells + 1))
    best = np.full((len(ask), take), np.inf)
    who = np.full((len(ask), take), -1, np.int64)
    for cell in range(cells):
        rows, members = asked[ends[cell]:ends[cell + 1]] // probes, by_cell[starts[cell]:starts[cell + 1]]
        if not len(rows) or not len(members):
            continue
        lane = max(1, HELD // (take + len(members)))
        for some in (rows[i:i + lane] for i in range(0, len(rows), lane)):
            both = np.concatenate([best[some], squared(ask[some], offer[members])], axis=1)
            names = np.concatenate([who[some], np.broadcast_to(members, (len(some), len(members)))], axis=1)
            at = np.argpartition(both, take - 1, axis=1)[:, :take]
            best[some], who[some] = np.take_along_axis(both, at, axis=1), np.take_along_axis(names, at, axis=1)
    return who


def _laned(points: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    return points.join(sizes, by).withColumn("lane", F.pmod(F.xxhash64("vid"), F.ceil(F.col("n") / LANE)))


def _renamed(df: DataFrame) -> DataFrame:
    """The same columns under new identities: both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _over_lanes(rows: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    return _renamed(rows.join(sizes.select(*by, "n"), by).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / LANE) - 1))).drop("n"))


def _routed(points: DataFrame, centres: DataFrame, sizes: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of ``points`` and ``cells``: the first ``probes`` (a column of ``sizes``) coarse cells by distance to the border."""
    def nearest(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*columns, "cells"])
        near = near.sort_values("cell")
        c = matrix(near["centre"])
        order = border(squared(matrix(rows["vec"]), c), distances(c, c)).argsort(axis=1, kind="stable")[:, :int(rows["probes"].iloc[0])]
        return rows.assign(cells=list(near["cell"].to_numpy()[order]))[[*columns, "cells"]]

    key = [*by, "lane"]
    asked = _laned(points, sizes.select(*by, "n", "probes"), by)
    return asked.groupBy(*key).cogroup(_over_lanes(centres, sizes, by).groupBy(*key)).applyInPandas(
        nearest, ", ".join([*fields(points, columns), "cells array<long>"]))


def _needed_probes(points: DataFrame, placed: DataFrame, centres: DataFrame, sizes: DataFrame, by: list[str], k: int, share: float) -> DataFrame:
    """(by, probes): how many coarse cells hold ``share`` of the neighbours of a sample."""
    key = [*by, "lane"]
    some = F.pmod(F.xxhash64("vid", F.lit(7)), F.lit(1 << 30)) < F.lit(SAMPLE * (1 << 30)) / F.col("n")
    sample = cut_lineage(points.join(sizes.select(*by, "n"), by).filter(some).drop("n"))
    offered = _laned(points, sizes.select(*by, "n"), by).withColumnRenamed("vid", "neighbor").select(*key, "neighbor", "vec", "copies")
    found = _over_lanes(sample, sizes, by).groupBy(*key).cogroup(offered.groupBy(*key)).applyInPandas(best_of_blocks(by, k), near_fields(points, by))
    true = top_rows(found, [*by, "vid"], ["distance", "neighbor"], k).filter("vid <> neighbor")
    every = sizes.withColumn("probes", F.lit(1 << 30))
    ranked = _routed(sample, centres, every, by, [*by, "vid"]).select(*by, "vid", F.posexplode("cells").alias("rank", "cell"))
    held = true.join(placed.select(*by, F.col("vid").alias("neighbor"), "cell"), [*by, "neighbor"]).join(ranked, [*by, "vid", "cell"])
    return held.groupBy(*by).agg((F.ceil(F.percentile("rank", share)) + 1).cast("int").alias("probes"))


def close_vectors(points: DataFrame, by: list[str], k: int, recall: float = 0.95, probe: int | None = None, pivots: int | None = None) -> DataFrame:
    """(by, vid, neighbor, distance, copies): about ``recall`` of the ``k`` nearest different vectors, the vector itself included.

    ``points``: by, vid, vec, copies. A third of what may be missed is left to the choice of coarse cells, a third to that of fine ones, a third to chance.
    ``pivots`` fixes the number of coarse cells of a group, ``probe`` how many of them are looked into.
    """
    share = 1 - (1 - recall) / 3
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("vid").alias("first"))
    cells = F.lit(pivots) if pivots else F.when(F.col("n") <= WHOLE, 1).otherwise(F.ceil(F.sqrt(F.col("n") / CELL)))
    sizes = cut_lineage(sizes.withColumn("coarse", cells.cast("long")))
    chosen = (F.pmod(F.xxhash64("vid", F.lit(5)), F.lit(1 << 30)) < F.lit(1 << 30) * F.col("coarse") / F.col("n")) | (F.col("vid") == F.col("first"))
    if pivots:
        centres = top_rows(points, by, [F.xxhash64("vid", F.lit(5)), F.col("vid")], pivots)
    else:
        centres = points.join(sizes, by).filter((F.col("coarse") > 1) & chosen | (F.col("vid") == F.col("first")))
    centres = centres.select(*by, F.col("vid").alias("cell"), F.col("vec").alias("centre"))
    centres = cut_lineage(centres)
    home = _routed(points, centres, sizes.withColumn("probes", F.lit(1)), by, [*by, "vid", "vec", "copies"])
    placed = cut_lineage(home.withColumn("cell", F.col("cells")[0]).drop("cells"))
    if probe:
        sizes = sizes.withColumn("probes", F.lit(probe))
    else:
        needed = _needed_probes(points, placed, centres, sizes, by, k, share)
        sizes = cut_lineage(sizes.join(needed, by, "left").fillna({"probes": 1}))
    parts = cut_lineage(placed.groupBy(*by, "cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")))

    def every(name: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))

    routed = _routed(points, centres, sizes, by, [*by, "vid", "vec"]).withColumn("cell", F.explode("cells")).drop("cells")
    asks = routed.groupBy(*by, "cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("lanes"))
    plan = cut_lineage(parts.join(asks, [*by, "cell"]))
    key = [*by, "cell", "part", "lane"]
    asking = routed.join(plan, [*by, "cell"]).withColumns({"lane": F.pmod(F.xxhash64("vid"), "lanes"), "part": every("parts")}).select(*key, "vid", "vec")
    offered = placed.join(plan, [*by, "cell"]).withColumns({"part": F.pmod(F.xxhash64("vid", F.lit(3)), "parts"), "lane": every("lanes")}).select(
        *key, F.col("vid").alias("neighbor"), "vec", "copies")
    offered = _renamed(offered)

    def search(ask: pd.DataFrame, offer: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "vid", "neighbor", "distance", "copies"]
        if not len(ask) or not len(offer):
            return pd.DataFrame(columns=names)
        offer = offer.sort_values("neighbor")
        a, b = matrix(ask["vec"]), matrix(offer["vec"])
        at = close_rows(a, b, k, share)
        rows, place = np.nonzero(at >= 0)
        cols = at[rows, place]
        exact = np.concatenate([np.sqrt(((a[rows[i:i + 65536]] - b[cols[i:i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(rows), 65536)])
        who = offer["neighbor"].to_numpy()[cols]
        order = np.lexsort((who, exact, rows))
        rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        order = order[rank < k]
        out = pd.DataFrame({"vid": ask["vid"].to_numpy()[rows[order]], "neighbor": who[order], "distance": exact[order], "copies": offer["copies"].to_numpy()[cols[order]]})
        for name in by:
            out[name] = ask[name].iloc[0]
        return out[names]

    found = asking.groupBy(*key).cogroup(offered.groupBy(*key)).applyInPandas(search, near_fields(points, by))
    return top_rows(found, [*by, "vid"], ["distance", "neighbor"], k)
