"""Near copies for the pipeline: SimHash first, then whatever of the similarity asked for SimHash cannot see.

The fingerprints of ``simhash`` (a bit for the majority of a text's shingle hashes) are searched for pairs of two or fewer
differing bits by the positional byte index with its guaranteed count, and each pair is verified on the shingle sets. That
connects the closest copies, the large groups of them above all. Texts of similarity 0.8 differ in about ten of 64 bits, which
no index of fingerprints finds for certain; so the rest comes from the join of the sets (``setjoin``), which only compares
what is not connected yet. No link is missed at any number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.inputs import join_hot, tidied
from emberlog.llm.runs import unpack
from emberlog.llm.setjoin import set_components, verified
from emberlog.llm.simhash import majority, near_links
from emberlog.session import written

MAX_BITS = 2


def simhash_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): verified links between ``sets`` (node, n, sketch, hashes) whose fingerprints differ in at most two bits: enough of them
    to connect equal fingerprints with the first of their sets, and these with each other."""
    def make(batches):
        for batch in batches:
            found = np.array([majority(unpack(x)) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["node", "fp"])

    prints = written(sets.select("node", "hashes").mapInArrow(tidied(make), "node long, fp long"))
    first = written(prints.groupBy("fp").agg(F.min("node").alias("first")))
    same = join_hot(prints, first, "fp", F.col("node")).filter(F.col("node") > F.col("first")).select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = near_links(first, MAX_BITS)
    for side in "uv":
        near = near.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"n_{side}")), side)
    near = near.select(F.least("n_u", "n_v").alias("u"), F.greatest("n_u", "n_v").alias("v"))
    return verified(written(same.union(near).distinct()), sets, similarity)


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row of ``docs``: the identifier, ``text_sha256``, ``group_id`` (smallest identifier of its group), ``kept``.

    Rows are linked if the Jaccard similarity of their sets of ``words``-word shingles (A-Z lower-cased; fewer words: the whole
    sequence; null and empty texts: the empty set, all alike) is at least ``similarity``; a group is what links connect. One row
    of each group is kept: the smallest identifier, of equal identifiers the first read; null identifiers come last. An empty
    table gives no rows. Every link is found, and verified on the whole sets of shingles (of 64-bit hashes).
    """
    judged, found = set_components(docs, id_column, text_column, words, similarity, lambda sets: simhash_links(sets, similarity))
    # A set without partners is a group by its row; all empty sets are one group.
    rooted = join_hot(judged, found, "sha", F.col("tag")).withColumn("group", F.when(F.col("root").isNotNull(), F.struct(F.lit(0).alias("kind"), F.col("root").alias("of")))
                      .when(F.col("n") == 0, F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("of"))).otherwise(F.struct(F.lit(2).alias("kind"), F.col("tag").alias("of"))))
    rooted = written(rooted.select("id", "tag", "sha", "group"))
    best = rooted.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("best"))
    out = join_hot(rooted, best, "group", F.col("tag"))
    return out.select(F.col("id").alias(id_column), F.lower(F.hex("sha")).alias("text_sha256"), F.col("best.id").alias("group_id"), (F.col("tag") == F.col("best.tag")).alias("kept"))
