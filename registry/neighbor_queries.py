"""Nearest neighbours, outlier factor, vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from emberlog.operators import neighbors as n
from emberlog.operators import outlier as o
from emberlog.operators.vectors import encode_with, tfidf_vectors
from registry.common import doc_lines, logs, registrar, table, with_ctes

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

SCOPE = "'set' || CAST(label % 3 AS STRING)"
# All three groups of the table, and pairs within a group; cosine and Euclidean distance.
PAIRS_SQL = """v AS (SELECT vec_id, 'set' || CAST(label % 3 AS STRING) AS source_file, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 sizes AS (SELECT source_file, count(*) AS n FROM v GROUP BY 1),
 cosine AS (SELECT source_file, a.vec_id AS row_id, b.vec_id AS neighbor, CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE list_cosine_distance(a.e, b.e) END AS distance FROM v a JOIN v b USING (source_file)),
 near AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, neighbor) AS rank FROM cosine QUALIFY rank <= 5)"""


def lof_sql(k: int) -> str:
    return f"""euclid AS (SELECT source_file, a.vec_id AS row_id, b.vec_id AS neighbor, list_distance(a.e, b.e) AS d FROM v a JOIN v b USING (source_file) WHERE a.vec_id <> b.vec_id),
 knn AS (SELECT * FROM euclid QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, neighbor) <= {k}),
 kd AS (SELECT row_id, max(d) AS kd FROM knn GROUP BY 1),
 lrd AS (SELECT knn.row_id, 1 / (avg(greatest(kd.kd, d)) + 1e-10) AS lrd FROM knn JOIN kd ON knn.neighbor = kd.row_id GROUP BY 1),
 lof AS (SELECT knn.source_file, knn.row_id, -avg(l.lrd) / any_value(m.lrd) AS factor FROM knn JOIN lrd l ON knn.neighbor = l.row_id JOIN lrd m ON knn.row_id = m.row_id GROUP BY ALL)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").selectExpr("vec_id AS row_id", f"{SCOPE} AS source_file", "embedding")


@query("j4_neighbor_pairs", f"WITH {PAIRS_SQL} SELECT row_id, neighbor, round(distance, 6) AS distance FROM near")
def _(spark, sf):
    near = n.neighbor_pairs(_vectors(spark, sf), ["source_file"])
    return near.select(F.col("vid").alias("row_id"), "neighbor", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query("m2_knn_score", f"WITH {PAIRS_SQL} SELECT row_id, round(avg(distance), 6) AS anomaly_score FROM near GROUP BY 1")
def _(spark, sf):
    return n.knn_score(_vectors(spark, sf)).select("row_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("m3_knn_score_approx", f"WITH {PAIRS_SQL} SELECT row_id, round(avg(distance), 6) AS anomaly_score FROM near GROUP BY 1")
def _(spark, sf):
    """A task compares up to a thousand vectors with each other whole, so on a small table the answer is exact."""
    return n.knn_score_approx(_vectors(spark, sf)).select("row_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("m3_knn_score_all_cells", f"WITH {PAIRS_SQL} SELECT row_id, round(avg(distance), 6) AS anomaly_score FROM near GROUP BY 1")
def _(spark, sf):
    """Looking into all cells is exact, which checks the cells and blocks themselves."""
    return n.knn_score_approx(_vectors(spark, sf), probe=12, pivots=12).select("row_id", F.round("anomaly_score", 6).alias("anomaly_score"))


# The index must find 95 of 100 true neighbours: the exact pairs, and whether that many were found.
RECALL_SQL = "SELECT source_file, count(*) AS pairs, TRUE AS found_95_of_100 FROM near WHERE row_id <> neighbor GROUP BY 1"


def _recall(rows, **index):
    """Per group: exact pairs of a row with another, and whether the index finds 95 of 100."""
    key = ["source_file", "vid", "neighbor"]
    exact = n.neighbor_pairs(rows, ["source_file"]).filter("vid <> neighbor").select(*key)
    near = n.neighbor_pairs(rows, ["source_file"], how=n.Approximate(**index)).select(*key, F.lit(1).alias("found"))
    both = exact.join(near, key, "left").groupBy("source_file").agg(F.count(F.lit(1)).alias("pairs"), F.count("found").alias("found"))
    return both.select("source_file", "pairs", (F.col("found") >= 0.95 * F.col("pairs")).alias("found_95_of_100"))


@query("m3_recall", f"WITH {PAIRS_SQL} {RECALL_SQL}")
def _(spark, sf):
    """Many coarse cells even on a small table, so that the choice of cells is at work."""
    return _recall(_vectors(spark, sf), pivots=12)


@query("m4_lof_label", f"""WITH {PAIRS_SQL}, {lof_sql(5)} SELECT row_id, round(-factor, 6) AS lof_score, CASE WHEN factor < cut THEN -1 ELSE 1 END AS lof_label
 FROM lof JOIN (SELECT source_file, quantile_cont(factor, 0.05) AS cut FROM lof GROUP BY 1) USING (source_file)""")
def _(spark, sf):
    return o.lof_label(_vectors(spark, sf)).select("row_id", F.round("lof_score", 6).alias("lof_score"), "lof_label")


@query("m5_lof_scores", f"WITH {PAIRS_SQL}, {lof_sql(20)} SELECT row_id, round(factor, 6) AS negative_factor, CASE WHEN factor < -1.5 THEN -1 ELSE 1 END AS lof_label FROM lof")
def _(spark, sf):
    return o.lof_scores(_vectors(spark, sf)).select("row_id", F.round("negative_factor", 6).alias("negative_factor"), "lof_label")


@query("m6_lof_threshold", f"WITH {PAIRS_SQL}, {lof_sql(20)} SELECT row_id, round(factor, 6) AS lof_score, factor <= -1.2 AS is_lof_anomaly FROM lof")
def _(spark, sf):
    return o.mark_lof(_vectors(spark, sf), threshold=-1.2, vector="embedding").select("row_id", F.round("lof_score", 6).alias("lof_score"), "is_lof_anomaly")


@query("m1_embed_logs")
def _(spark, sf):
    out = tfidf_vectors(logs(spark, sf), size=64)
    return out.select("row_id", F.transform("embedding", lambda x: F.round(x, 6)).cast("string").alias("embedding"))


# All terms of the vocabulary: the weights of a line, smallest first, in millionths.
TFIDF_SQL = r"""terms AS (SELECT row_id, unnest(regexp_extract_all(lower(log), '[\p{L}\p{N}_]{2,}')) AS term FROM logs),
 tf AS (SELECT row_id, term, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM logs),
 w AS (SELECT row_id, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
 unit AS (SELECT row_id, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS x FROM w)"""


@query("m1_vocabulary", with_ctes("SELECT row_id, string_agg(CAST(CAST(round(x * 1000000) AS BIGINT) AS STRING), ',' ORDER BY x) AS weights FROM unit GROUP BY 1", TFIDF_SQL))
def _(spark, sf):
    """Vectors as wide as the vocabulary, never spread out: their text lists the entries that are not zero."""
    out = tfidf_vectors(logs(spark, sf), size=1 << 18, vocabulary=True, sparse=True)
    entries = F.split(F.regexp_extract(F.col("embedding").cast("string"), r"\[([^\]]*)\]\)$", 1), ",")
    numbers = F.array_sort(F.transform(entries, lambda x: x.cast("double")))
    return out.select("row_id", F.array_join(F.transform(numbers, lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("weights"))


def _letter_encoder():
    """Stand-in for a user's model: letter frequencies of a line."""
    def encode(lines: list[str]) -> np.ndarray:
        return np.array([[line.lower().count(ch) for ch in "abcdefghijklmnopqrstuvwxyz"] for line in lines])
    return encode


@query("m1_encode_with", "SELECT doc_id * 100000 + i AS row_id, CAST(length(line) - length(replace(lower(line), 'e', '')) AS DOUBLE) AS n_e FROM "
       "(SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def _(spark, sf):
    out = encode_with(doc_lines(spark, sf), _letter_encoder)
    return out.select("row_id", F.col("embedding")[4].cast("double").alias("n_e"))


@query("knn_on_log_text")
def _(spark, sf):
    vectors = tfidf_vectors(logs(spark, sf), size=64)
    return n.knn_score(vectors).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.max("anomaly_score"), 4).alias("max_score"), F.round(F.avg("anomaly_score"), 4).alias("mean_score"))
