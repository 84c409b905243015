"""Evaluate an expensive expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column that later expressions read instead of repeating.

    The optimizer merges projections and pushes filters through them by copying
    expressions. A dozen patterns copied into every use make one generated method
    too long to compile. A one-element explode is a step it does not copy through.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
