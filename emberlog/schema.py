"""Shapes of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT_TYPE = T.ArrayType(T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("log", T.StringType()),
]))

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("log", T.StringType()),
    T.StructField("context_logs", CONTEXT_TYPE),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("has_secret", T.BooleanType()),
])


def default_columns(df: DataFrame) -> DataFrame:
    """Add the verdict columns that are not there yet, with their neutral value."""
    neutral = {
        "is_behavioral": F.lit(False),
        "behavioral_rule": F.lit(None).cast("string"),
        "is_rule_based": F.lit(False),
        "is_security_related": F.lit(False),
        "is_anomaly": F.lit(0),
        "classification": F.lit(None).cast("string"),
        "reason": F.lit(None).cast("string"),
        "tag": F.array().cast("array<string>"),
        "anomaly_source": F.lit(None).cast("string"),
    }
    return df.withColumns({n: c for n, c in neutral.items() if n not in df.columns})
