"""Local outlier factor (Breunig et al., SIGMOD 2000) on the neighbour table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberlog.operators.neighbors import (
    Approximate, _search, _taken, distinct_vectors, group_sizes, join_by_vector, knn_of, unit_neighbors)
from emberlog.operators.ordering import HOT_ROWS, hot_limit
from emberlog.operators.selection import values_at
from emberlog.operators.vectors import tfidf_vectors
from emberlog.session import cut_lineage, written


def lof_of(near: DataFrame, sizes: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """(by, vid, ``name``): the negated factor, from the ``k + 1`` nearest different vectors (by, vid, neighbor, distance, copies)."""
    limit = F.least(F.lit(k).cast("long"), F.col("_rows") - 1)
    near = cut_lineage(_taken(near.join(sizes, by), by, limit, F.col("copies") - 1).select(*by, "vid", "neighbor", "distance", "taken"))
    reach = near.groupBy(*by, "vid").agg(F.max("distance").alias("k_distance"))
    density = (
        near.join(reach.withColumnRenamed("vid", "neighbor"), [*by, "neighbor"])
        .groupBy(*by, "vid")
        .agg((F.sum(F.greatest("k_distance", "distance") * F.col("taken")) / F.sum("taken")).alias("_mean"))
        .select(*by, "vid", (1.0 / (F.col("_mean") + 1e-10)).alias("density"))
    )
    around = (
        near.join(density.select(*by, F.col("vid").alias("neighbor"), F.col("density").alias("_theirs")), [*by, "neighbor"])
        .groupBy(*by, "vid").agg((F.sum(F.col("_theirs") * F.col("taken")) / F.sum("taken")).alias("_around"))
    )
    return around.join(density, [*by, "vid"]).select(*by, "vid", (-F.col("_around") / F.col("density")).alias(name))


def lof_factor(df: DataFrame, by: list[str] | None = None, k: int = 20, vector: str = "embedding", row_id: str = "row_id",
               name: str = "lof_score", copies: str | None = None, how: Approximate | None = None) -> DataFrame:
    """Add the negated factor: about -1 for ordinary rows, lower for outliers.

    Works on different vectors with their number of copies: joins and group-bys only.
    ``copies`` names a column saying how many equal rows a row stands for; ``how`` asks for the approximate search.
    """
    by = ["source_file"] if by is None else by
    points = cut_lineage(distinct_vectors(df, by, vector, row_id, copies))
    factor = lof_of(_search(points, by, k + 1, how), group_sizes(df, by, copies), by, k, name)
    keyed = points.join(factor, [*by, "vid"], "left").select(*by, "vec", F.coalesce(name, F.lit(0.0)).alias(name))
    return join_by_vector(df, keyed, by, vector)


def knn_and_lof(df: DataFrame, by: list[str], k: int, lof_k: int, vector: str, row_id: str, name: str,
                copies: str | None = None, how: Approximate | None = None) -> DataFrame:
    """Add ``anomaly_score`` (``knn_score``) and the negated outlier factor ``name`` from one search and one table of neighbours.

    Both are taken on vectors of length one, as log lines have them.
    """
    points = cut_lineage(distinct_vectors(df, by, vector, row_id, copies))
    near = cut_lineage(unit_neighbors(points, by, max(k, lof_k + 1), how))
    sizes = group_sizes(df, by, copies)
    scores = knn_of(near, sizes, by, k).join(lof_of(near, sizes, by, lof_k, name), [*by, "vid"], "full")
    keyed = points.join(scores, [*by, "vid"], "left").select(*by, "vec", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("anomaly_score", name)))
    return join_by_vector(df, keyed, by, vector)


def lof_scores(df: DataFrame, by: list[str] | None = None, k: int = 20, vector: str = "embedding",
               row_id: str = "row_id") -> DataFrame:
    """Negated factor and label with the fixed cut at -1.5."""
    scored = lof_factor(df, by, k, vector, row_id, "negative_factor")
    return scored.withColumn("lof_label", F.when(F.col("negative_factor") < -1.5, -1).otherwise(1))


def lof_label(df: DataFrame, by: list[str] | None = None, k: int = 5, contamination: float = 0.05,
              vector: str = "embedding", row_id: str = "row_id", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``lof_score`` (higher is worse) and ``lof_label`` (-1 beyond the contamination quantile)."""
    by = ["source_file"] if by is None else by
    return label_by_quantile(cut_lineage(lof_factor(df, by, k, vector, row_id, "_factor")), by, contamination, row_id, hot_rows)


def label_by_quantile(scored: DataFrame, by: list[str], contamination: float, row_id: str = "row_id",
                      hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Turn ``_factor`` into ``lof_score`` and ``lof_label``. The quantile is exact,
    linearly interpolated; a large input is not ordered for it (``selection``)."""
    at = F.lit(contamination) * (F.col("_rows") - 1)
    low = F.floor(at)
    sizes = group_sizes(scored, by)
    if hot_limit(scored, hot_rows) is None:
        ranks = scored.select(*by, "_factor", F.row_number().over(Window.partitionBy(*by).orderBy("_factor", row_id)).alias("_rank"))
        found = ranks.join(sizes, by).groupBy(*by, "_rows").agg(
            F.max(F.when(F.col("_rank") == low + 1, F.col("_factor"))).alias("value"), F.max(F.when(F.col("_rank") == low + 2, F.col("_factor"))).alias("next"))
    else:
        found = values_at(scored.select(*by, "_factor"), by, "_factor", cut_lineage(sizes.select(*by, (low + 1).alias("rank")))).join(sizes, by)
    edges = found.select(*by, F.when(F.col("_rows") >= 2, F.col("value") + (F.coalesce("next", "value") - F.col("value")) * (at - low)).alias("_cut"))
    return (
        scored.join(written(edges), by)  # a file's size is known, so rows are not laid out by group to meet their cut
        .withColumn("lof_label", F.when(F.col("_factor") < F.col("_cut"), -1).otherwise(1))
        .withColumn("lof_score", F.abs("_factor")).drop("_factor", "_cut")
    )


def mark_lof(df: DataFrame, by: list[str] | None = None, threshold: float = -1.5, k: int = 20,
             vector: str | None = None, row_id: str = "row_id", size: int = 256, vocabulary: int | None = None) -> DataFrame:
    """Add ``lof_score`` and ``is_lof_anomaly``; lines are vectorised by TF-IDF unless a vector column is given.

    Terms are hashed into ``size`` slots, none is left out. ``vocabulary`` asks for that many of the most frequent terms instead.
    """
    rows = df if vector else tfidf_vectors(df, size=vocabulary or size, vocabulary=vocabulary is not None)
    scored = lof_factor(rows, by, k, vector or "embedding", row_id, "lof_score")
    out = scored.withColumn("is_lof_anomaly", F.col("lof_score") <= threshold)
    return out if vector else out.drop("embedding")
