"""What the operators share: reading, spreading, joining on hot keys."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberlog.session import written

BATCH_BYTES = "8m"
READ_ROWS = "256"


def prepare(spark: SparkSession) -> None:
    """Session settings the operators count on: adaptive plans, and Arrow batches bounded by
    bytes as well as by rows (a batch of very long texts must fit in a worker), and few rows in a batch
    of the Parquet reader (its buffers of long texts are large single arrays, which fragment the heap)."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores if its files give fewer partitions than that (one small file);
    a table of many files stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id`` and ``text`` alone; a null text is empty."""
    prepare(docs.sparkSession)
    return spread(docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")))


def id_type(docs: DataFrame, id_column: str) -> str:
    return docs.schema[id_column].dataType.simpleString()


def tidied(work):
    """``work`` (batches in, batches out), giving memory back when a task ends: a worker process lives on
    between tasks, and what it still holds is missing on its executor."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
    return run


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def placed(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``number`` (from 0 in its group) and ``n`` (size of the group), written. Groups of any size are laid out
    by range; a slice of the layout needs the number of rows before it only."""
    spark = rows.sparkSession
    laid = rows.repartitionByRange(width(spark), by, *order).sortWithinPartitions(by, *order)
    laid = written(laid.withColumns({"slice": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    sizes = laid.groupBy(by, "slice").agg(F.count("*").alias("here"), F.min("at").alias("start"))
    before = Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "slice", "start", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("earlier"), F.sum("here").over(Window.partitionBy(by)).alias("n"))
    joined = laid.join(sizes, [by, "slice"])
    return written(joined.withColumn("number", F.col("at") - F.col("start") + F.col("earlier")).drop("slice", "at", "start", "earlier"))


def join_hot(rows: DataFrame, table: DataFrame, key: str, salt_from: Column) -> DataFrame:
    """``rows`` left-joined to ``table`` (one row a key), where one key may hold a third of ``rows``.

    The different (key, salt) pairs fetch the table's row first; a hot key has only as many
    of these as there are salts. Each row then joins its own (key, salt).
    """
    salts = 2 * width(rows.sparkSession)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)))
    wanted = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(wanted, [key, "_salt"], "left").drop("_salt")


def keep_rows(docs: DataFrame, judged: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, in all their columns, that ``judged`` (identifier, text_sha256, kept) keeps.

    A row is found again by its identifier and text. Of rows equal in both the first read stays, if any is kept. Columns may have any
    names and types.
    """
    def name(column: str):
        return F.col("`" + column.replace("`", "``") + "`")
    key = F.concat_ws("-", F.coalesce(name(id_column).cast("string"), F.lit("null")), F.sha2(F.coalesce(name(text_column), F.lit("")), 256))
    of = judged.select(F.concat_ws("-", F.coalesce(name(id_column).cast("string"), F.lit("null")), "text_sha256").alias("key"), "kept")
    of = of.groupBy("key").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).filter("kept")
    of = written(of)
    rows = docs.select(F.struct(*map(name, docs.columns)).alias("row"), key.alias("key"), F.monotonically_increasing_id().alias("at"))
    rows = rows.join(of, "key", "left_semi")
    if not of.filter("rows > 1").isEmpty():
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("at"))).filter("place = 1")
    return rows.select("row.*")
