"""From raw documents to encoded training text: one stage after the other, each on all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.bpe import bpe_encode
from emberlog.llm.exact import exact_duplicates
from emberlog.llm.inputs import keep_rows, prepare
from emberlog.llm.langid import in_a_language, train
from emberlog.llm.mixing import repeated
from emberlog.llm.nearcopies import near_copies
from emberlog.session import scratch_path, ship

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LEAST_SCORE = 0.15


def _ready(spark: SparkSession) -> None:
    ship(spark, os.path.join(os.path.dirname(os.path.abspath(__file__)), "emberlog"))
    prepare(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language of the corpus: those without a letter, and those hardly any of whose n-grams
    belong to the language that fits best, go. Without a labelled row all stay; so does a text too short for an n-gram."""
    _ready(spark)
    return in_a_language(docs, train(docs), LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with the same text the one with the largest identifier stays."""
    _ready(spark)
    return keep_rows(docs, exact_duplicates(docs, keep="largest"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest identifier stays."""
    _ready(spark)
    return keep_rows(docs, near_copies(docs, words=5, similarity=0.8))


def five_two_one(names: list) -> list[float]:
    """Weights by code point order of the sources: 5, 2, 1, repeating."""
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them (0 to 3 times)."""
    _ready(spark)
    return repeated(docs, five_two_one)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether decoding them gives the text back."""
    _ready(spark)
    done = bpe_encode(docs, VOCABULARY, decoded="decoded")
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("language identification", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixture), ("BPE", encoded)]

# The stages learn filters, link near copies and merge tokens: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stands between two stages is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
