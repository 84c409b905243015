"""Vectors for log lines: TF-IDF on Spark ML, or a user's own encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tfidf_vectors(df: DataFrame, size: int = 256, vocabulary: bool = False, log: str = "log",
                  name: str = "embedding", sparse: bool = False) -> DataFrame:
    """Unit-length TF-IDF vectors: tf * (ln((1+n)/(1+df)) + 1).

    Terms are hashed into ``size`` slots, so nothing grows with the data. With
    ``vocabulary`` the ``size`` most frequent terms are used instead. Vectors stay sparse until the end: with ``sparse`` the
    column is a vector of the ml package with its non-zero entries only, else an array of ``size`` numbers. A line without terms
    has the zero vector.
    """
    tokens = RegexTokenizer(inputCol=log, outputCol="_tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    if vocabulary:
        counts = CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=size)
    else:
        counts = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=size)
    counted = Pipeline(stages=[tokens, counts]).fit(df)
    weights = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted.transform(df)).idf.toArray() + 1  # one number a slot
    scaled = ElementwiseProduct(inputCol="_tf", outputCol="_w", scalingVec=Vectors.dense(weights)).transform(counted.transform(df))
    unit = Normalizer(inputCol="_w", outputCol="_unit", p=2.0).transform(scaled)
    return unit.withColumn(name, F.col("_unit") if sparse else vector_to_array("_unit")).drop("_tokens", "_tf", "_w", "_unit")


def encode_with(df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
                log: str = "log", name: str = "embedding") -> DataFrame:
    """Vectors from a user function. ``make_encoder`` runs once per task; every
    distinct line is encoded once and joined back."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for pdf in batches:
            vectors = np.asarray(encode(pdf[log].tolist()), dtype=np.float32) if len(pdf) else np.empty((0, 0))
            yield pd.DataFrame({log: pdf[log], name: list(vectors)})
    encoded = df.select(log).distinct().mapInPandas(run, f"`{log}` string, `{name}` array<float>")
    return df.join(encoded, log, "left")
