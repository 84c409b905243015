"""Exact k nearest neighbours as a partitioned join.

Equal vectors are merged first and carry their number of copies. Each group's
vectors are assigned to cells around pivots (the pivot partitioning of Lu et al.,
PVLDB 2012). From the cell radii and the few vectors closest to each pivot follows
a bound on the neighbour distance of a whole cell, and only pairs of cells that can
hold a neighbour within the bound are compared. A comparison is a task on two
blocks of bounded size that returns the best ``k`` per row, never all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberlog.operators.cells import close_vectors
from emberlog.operators.distances import best_of_blocks, distances, fields, matrix, near_fields
from emberlog.operators.ordering import top_rows
from emberlog.session import cut_lineage, written

# Rows of a side of a comparison. What goes from task to task falls as a block grows, and the distances are taken in lanes of it.
BLOCK = 8192
WHOLE = 4096
# More pivots would cost more than they rule out: a plan's choice, every pair that may count is compared all the same.
MAX_PIVOTS = 256


def _weight(copies: str | None) -> Column:
    return F.sum(copies).cast("long") if copies else F.count(F.lit(1))


def distinct_vectors(df: DataFrame, by: list[str], vector: str, row_id: str, copies: str | None = None) -> DataFrame:
    """(by, vec, vid, copies): one row per different vector of a group."""
    return df.groupBy(*by, F.col(vector).cast("array<double>").alias("vec")).agg(
        F.min(row_id).alias("vid"), _weight(copies).alias("copies"))


def _assign(points: DataFrame, by: list[str], pivots_per_group: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Add the nearest pivot (cell) and the distance to it."""
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumns({"_pivots": pivots_per_group, "_lanes": F.ceil(F.col("_n") / BLOCK)})
    sampled = top_rows(points.select(*by, "vid", "vec"), by, [F.xxhash64("vid"), F.col("vid")], most)
    order = F.xxhash64("vid")
    pivots = (
        sampled.join(sizes, by)
        .groupBy(*by, "_pivots", "_lanes")
        .agg(F.array_sort(F.collect_list(F.struct(order.alias("h"), "vid", "vec"))).alias("p"))
        .select(*by, "_lanes", F.explode(F.slice("p", F.lit(1), F.col("_pivots"))).alias("p"))
        .select(*[F.col(n).alias(n) for n in by], F.col("p.vid").alias("pivot"), F.col("p.vec").alias("pivot_vec"), "_lanes")
    )
    spread = pivots.withColumn("_lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lanes") - 1))).drop("_lanes")
    laned = points.join(sizes.select(*by, "_lanes"), by).withColumn(
        "_lane", F.pmod(F.xxhash64("vid"), F.col("_lanes"))).drop("_lanes")

    def nearest_pivot(rows: pd.DataFrame, piv: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=names)
        piv = piv.sort_values("pivot")
        d = distances(matrix(rows["vec"]), matrix(piv["pivot_vec"]))
        at = np.argmin(d, axis=1)
        return rows.assign(cell=piv["pivot"].to_numpy()[at], to_pivot=d[np.arange(len(rows)), at])[names]

    names = [*by, "vid", "vec", "copies", "cell", "to_pivot"]
    out = ", ".join(fields(points, [*by, "vid", "vec", "copies"]) + ["cell long", "to_pivot double"])
    key = [*by, "_lane"]
    assigned = laned.groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(nearest_pivot, out)
    return cut_lineage(assigned), pivots.drop("_lanes")


def _cell_pairs(cells: DataFrame, by: list[str], k: int) -> DataFrame:
    """Which cells to compare: all that can hold a neighbour. A group here is one group's pivots, at most MAX_PIVOTS rows."""
    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell").reset_index(drop=True)
        gap = distances(matrix(pdf["pivot_vec"]), matrix(pdf["pivot_vec"]))
        np.fill_diagonal(gap, 0.0)
        radius = pdf["radius"].to_numpy()
        closest = [np.sort(np.asarray(c, dtype=np.float64)) for c in pdf["closest"]]
        out = []
        for i in range(len(pdf)):
            reach = np.sort(np.concatenate([radius[i] + gap[i, j] + c for j, c in enumerate(closest)]))
            bound = reach[min(k, len(reach)) - 1] if len(reach) >= k else np.inf
            slack = 1e-6 * (gap.max() + radius.max())
            low, high = gap[i] - radius[i] - bound - slack, gap[i] + radius[i] + bound + slack
            out += [(pdf["cell"][i], pdf["cell"][j], low[j], high[j]) for j in range(len(pdf)) if low[j] <= radius[j]]
        frame = pd.DataFrame(out, columns=["cell", "other", "low", "high"])
        for name in by:
            frame[name] = pdf[name].iloc[0]
        return frame[[*by, "cell", "other", "low", "high"]]

    out = ", ".join(fields(cells, by) + ["cell long", "other long", "low double", "high double"])
    return cells.groupBy(*by).applyInPandas(pairs, out)


def _compare(assigned: DataFrame, cells: DataFrame, pairs: DataFrame, by: list[str], k: int) -> DataFrame:
    parts = cells.select(*by, "cell", F.ceil(F.col("size") / BLOCK).alias("parts"))
    mine = F.pmod(F.xxhash64("vid"), F.col("parts"))
    theirs = F.pmod(F.xxhash64("vid"), F.col("other_parts"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    sized = (
        pairs.join(parts, [*by, "cell"])
        .join(parts.select(*by, F.col("cell").alias("other"), F.col("parts").alias("other_parts")), [*by, "other"])
    )
    asking = (assigned.join(sized, [*by, "cell"])
              .withColumns({"part": mine, "other_part": every("other_parts")})
              .select(*by, "cell", "part", "other", "other_part", "vid", "vec"))
    offered = (assigned.withColumnRenamed("cell", "other").join(sized, [*by, "other"])
               .filter(F.col("to_pivot").between(F.col("low"), F.col("high")))
               .withColumns({"other_part": theirs, "part": every("parts")})
               .select(*[F.col(n).alias(n) for n in [*by, "cell", "part", "other", "other_part"]],
                       F.col("vid").alias("neighbor"), F.col("vec").alias("vec"), F.col("copies").alias("copies")))

    key = [*by, "cell", "part", "other", "other_part"]
    found = asking.groupBy(*key).cogroup(offered.groupBy(*key)).applyInPandas(best_of_blocks(by, k), near_fields(assigned, by))
    return top_rows(found, [*by, "vid"], ["distance", "neighbor"], k)


def nearest_vectors(points: DataFrame, by: list[str], k: int, pivots: int | None = None) -> DataFrame:
    """(by, vid, neighbor, distance, copies): the ``k`` nearest different vectors, the vector itself included, by
    Euclidean distance, exactly. Equal distances go to the smaller id. What no bound on the cells rules out is compared: on
    vectors without structure the work is the square of the *different* vectors. ``close_vectors`` is the search that scales."""
    wanted = F.lit(pivots) if pivots else F.greatest(F.lit(1), F.least(F.lit(MAX_PIVOTS), F.floor(F.col("_n") / (BLOCK / 2)))).cast("int")
    if not pivots:
        wanted = F.when(F.col("_n") <= WHOLE, F.lit(1)).otherwise(wanted)
        largest = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) <= WHOLE:
            best = best_of_blocks(by, k)
            return points.groupBy(*by).applyInPandas(
                lambda pdf: best(pdf, pdf.rename(columns={"vid": "neighbor"})), near_fields(points, by))
    assigned, chosen = _assign(points, by, wanted, max(MAX_PIVOTS, pivots or 0))
    close = top_rows(assigned.select(*by, "cell", "vid", "to_pivot"), [*by, "cell"], ["to_pivot", "vid"], k)
    cells = cut_lineage(
        assigned.groupBy(*by, "cell").agg(F.max("to_pivot").alias("radius"), F.count(F.lit(1)).alias("size"))
        .join(close.groupBy(*by, "cell").agg(F.collect_list("to_pivot").alias("closest")), [*by, "cell"])
        .join(chosen.withColumnRenamed("pivot", "cell"), [*by, "cell"]))
    return _compare(assigned, cells, _cell_pairs(cells, by, k), by, k)


@dataclass(frozen=True)
class Approximate:
    """Look for about ``recall`` of the neighbours, in cells. ``pivots`` and ``probe`` fix the number of coarse cells of a group and of
    those looked into; by default both follow from the data (see ``cells``)."""
    recall: float = 0.95
    probe: int | None = None
    pivots: int | None = None


def _search(points: DataFrame, by: list[str], k: int, how: Approximate | None, pivots: int | None = None) -> DataFrame:
    return nearest_vectors(points, by, k, pivots) if how is None else close_vectors(points, by, k, how.recall, how.probe, how.pivots)


def _unit(points: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return points.withColumn("_norm", norm).withColumn(
        "vec", F.when(F.col("_norm") > 0, F.transform("vec", lambda x: x / F.col("_norm"))).otherwise(F.col("vec")))


def neighbor_pairs(df: DataFrame, by: list[str], k: int = 5, vector: str = "embedding", row_id: str = "row_id",
                   how: Approximate | None = None, pivots: int | None = None) -> DataFrame:
    """k nearest different vectors by cosine distance, itself included."""
    near = unit_neighbors(cut_lineage(distinct_vectors(df, by, vector, row_id)), by, k, how, pivots)
    return top_rows(_cosine(near), [*by, "vid"], ["distance", "neighbor"], k)


def unit_neighbors(points: DataFrame, by: list[str], k: int, how: Approximate | None = None, pivots: int | None = None) -> DataFrame:
    """(by, vid, neighbor, distance, copies, blank): at least the ``k`` nearest vectors once all have length one, by Euclidean distance.

    A zero vector stays as it is, at distance 1 from the others (``blank``: one of the two is zero); a group has one at most.
    Both scores are read from this table: by cosine and by Euclidean distance unit vectors come in the same order.
    """
    points = _unit(points)
    names = [*by, "vid", "neighbor", "distance", "copies"]
    some, zero = points.filter("_norm > 0").drop("_norm"), points.filter("_norm = 0").select(*by, F.col("vid").alias("zero"), F.col("copies").alias("zeros"))
    near = _search(some, by, k, how, pivots).select(*names, F.lit(False).alias("blank"))
    if zero.isEmpty():
        return near
    beside = some.select(*by, "vid").join(zero, by).select(*by, "vid", F.col("zero").alias("neighbor"), F.lit(1.0).alias("distance"), F.col("zeros").alias("copies"), F.lit(True).alias("blank"))
    own = zero.select(*by, F.col("zero").alias("vid"), F.col("zero").alias("neighbor"), F.lit(0.0).alias("distance"), F.col("zeros").alias("copies"), F.lit(True).alias("blank"))
    first = top_rows(some.join(zero, by).select(*by, F.col("zero").alias("vid"), F.col("vid").alias("neighbor"), F.lit(1.0).alias("distance"), "copies", F.lit(True).alias("blank")), by, ["neighbor"], k)
    return near.unionByName(beside).unionByName(own).unionByName(first)


def _cosine(near: DataFrame) -> DataFrame:
    """A zero vector has no direction: it is at cosine distance 1 from everything, itself included."""
    distance = F.when(F.col("blank"), F.lit(1.0)).otherwise(F.col("distance") * F.col("distance") / 2)
    return near.withColumn("distance", distance).drop("blank")


def _taken(near: DataFrame, by: list[str], limit: Column, own: Column) -> DataFrame:
    """How many copies of each neighbour are used, nearest first, ``limit`` in all."""
    order = Window.partitionBy(*by, "vid").orderBy("distance", "neighbor")
    usable = F.when(F.col("neighbor") == F.col("vid"), own).otherwise(F.col("copies"))
    before = F.coalesce(F.sum("_usable").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (near.withColumn("_usable", usable).withColumn("_before", before)
            .withColumn("taken", F.greatest(F.lit(0), F.least(F.col("_usable"), limit - F.col("_before"))))
            .filter(F.col("taken") > 0).drop("_usable", "_before"))


def join_by_vector(df: DataFrame, keyed: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Give every row the columns of its vector. Rows are matched on a hash of the vector,
    which is cheap to sort, and then on the vector itself. A ``keyed`` written as files has a known size: few vectors then
    meet all their rows where these are, and no task gets all rows of one vector."""
    rows = df.withColumns({"_vec": F.col(vector).cast("array<double>"), "_hash": F.xxhash64(F.col(vector).cast("array<double>"))})
    known = keyed.withColumn("_hash", F.xxhash64("vec"))
    on = [F.col(f"l.{n}") == F.col(f"r.{n}") for n in [*by, "_hash"]] + [F.col("l._vec") == F.col("r.vec")]
    joined = rows.alias("l").join(known.alias("r"), on)
    return joined.select(*[F.col(f"l.{n}") for n in df.columns], *[F.col(f"r.{n}") for n in keyed.columns if n not in [*by, "vec"]])


def group_sizes(df: DataFrame, by: list[str], copies: str | None = None) -> DataFrame:
    return df.groupBy(*by).agg(_weight(copies).alias("_rows"))


def knn_of(near: DataFrame, sizes: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, vid, anomaly_score) from a table of ``unit_neighbors``."""
    limit = F.least(F.lit(k).cast("long"), F.col("_rows") - 1)
    return (
        _taken(_cosine(near).join(sizes, by), by, limit, F.col("copies"))
        .groupBy(*by, "vid").agg((F.sum(F.col("distance") * F.col("taken")) / F.sum("taken")).alias("anomaly_score")))


def knn_score(df: DataFrame, by: list[str] | None = None, k: int = 5, vector: str = "embedding", row_id: str = "row_id",
              how: Approximate | None = None, pivots: int | None = None, copies: str | None = None) -> DataFrame:
    """Add ``anomaly_score``: mean cosine distance to the k nearest rows, itself included.

    ``copies`` names a column saying how many equal rows a row stands for.
    """
    by = ["source_file"] if by is None else by
    points = cut_lineage(distinct_vectors(df, by, vector, row_id, copies))
    near = cut_lineage(unit_neighbors(points, by, k, how, pivots))
    scores = knn_of(near, group_sizes(df, by, copies), by, k)
    keyed = points.join(scores, [*by, "vid"], "left").select(*by, "vec", F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"))
    return join_by_vector(df, written(keyed), by, vector)


def knn_score_approx(df: DataFrame, by: list[str] | None = None, k: int = 5, vector: str = "embedding", row_id: str = "row_id",
                     recall: float = 0.95, probe: int | None = None, pivots: int | None = None, copies: str | None = None) -> DataFrame:
    """``knn_score`` by the approximate search: about ``recall`` of the neighbours (see ``cells``)."""
    return knn_score(df, by, k, vector, row_id, Approximate(recall, probe, pivots), copies=copies)
