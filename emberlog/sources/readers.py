"""Log files to the log table ``source_file, line_no, ts_raw, ts, log``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from emberlog import catalogs as c
from emberlog.functions.text import strip
from emberlog.schema import CANDIDATE_SCHEMA
from emberlog.session import prepare

LOG_COLUMNS = ["source_file", "line_no", "ts_raw", "ts", "log"]


def parsed_time(ts_raw: Column) -> Column:
    """Timestamp, or null when the text is none."""
    return F.try_to_timestamp(ts_raw)


def _number_lines(rows: DataFrame) -> DataFrame:
    """Position in the file from file blocks, without a window over a file's rows.

    Rows of one block are read by one task in order, so the row counter of that
    task gives the position in the block; a small table (one row per block) says
    how many rows come before it.
    """
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        placed.groupBy("_path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select("_path", "_block", "_first", "_before")
    )
    return (
        placed.join(blocks, ["_path", "_block"])
        .withColumn("line_no", F.col("_before") + F.col("_at") - F.col("_first") + 1)
        .drop("_path", "_block", "_at", "_first", "_before")
    )


def _reader(spark: SparkSession, glob: str | None):
    prepare(spark)
    reader = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", False)
    return reader.option("pathGlobFilter", glob) if glob else reader


def _with_origin(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "source_file": F.col("_metadata.file_name"),
        "_path": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
    })


def scan_text_logs(spark: SparkSession, paths: str | list[str], glob: str | None = None, folders: list[str] | None = None) -> DataFrame:
    """One row per non-blank line: text before the first blank is the time, the rest the log. ``folders`` names levels
    of ``name=value`` folders below the path to keep as columns."""
    line, kept = strip("value"), list(folders or [])
    at = F.instr(F.col("_line"), " ")
    rows = (
        _with_origin(_reader(spark, glob).text(paths))
        .withColumn("_line", line)
        .filter(F.length("_line") > 0)
        .withColumns({
            "ts_raw": F.when(at > 0, F.substring(F.col("_line"), F.lit(1), at - 1)).otherwise(""),
            "log": F.when(at > 0, F.substring(F.col("_line"), at + 1, F.length("_line"))).otherwise(F.col("_line")),
        })
        .select("source_file", "_path", "_block", "ts_raw", "log", *kept)
    )
    return _number_lines(rows).withColumn("ts", parsed_time(F.col("ts_raw"))).select(*LOG_COLUMNS, *kept)


def _text_value(value: Column) -> Column:
    """Stripped text of a variant that holds text; null for anything else and for blank text."""
    return F.nullif(F.when(F.schema_of_variant(value) == "STRING", strip(value.cast("string"))), F.lit(""))


def json_message() -> Column:
    """Message of a record: object ``@message.log``, ``message``, ``log``, text ``@message``."""
    whole = F.col("@message")
    return F.coalesce(_text_value(F.try_variant_get(whole, "$.log", "variant")), _text_value(F.col("message")),
                      _text_value(F.col("log")), _text_value(whole))


def json_timestamp_pick() -> Column:
    """First time field with a value, as text."""
    def value(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.when(~text.isin("", "0", "false", "null", "[]", "{}"), text)
    return F.coalesce(*[value(n) for n in c.TIMESTAMP_FIELDS], F.lit(""))


RECORD_FIELDS = ["@message", "message", "log", *c.TIMESTAMP_FIELDS]


def _json_records(spark: SparkSession, paths: str | list[str], glob: str | None, fields: list[str], layout: str) -> DataFrame:
    """Fields of each record as variants. An array is streamed element by element, so only
    single values, never a whole file, have to fit into memory; lines can also be split."""
    schema = T.StructType([T.StructField(n, T.VariantType()) for n in fields])
    reader = _reader(spark, glob).schema(schema).option("mode", "PERMISSIVE").option("multiLine", layout == "array")
    return _with_origin(reader.json(paths))


def scan_json_logs(spark: SparkSession, paths: str | list[str], glob: str | None = None,
                   extra: list[str] | None = None, layout: str = "array") -> DataFrame:
    """Files holding a JSON array of records, or with ``layout="lines"`` one record per line.

    What does not parse gives no rows. ``extra`` names other top-level fields to keep as text.
    """
    kept = list(extra or [])
    rows = (
        _json_records(spark, paths, glob, [*RECORD_FIELDS, *[n for n in kept if n not in RECORD_FIELDS]], layout)
        .withColumns({"_log": json_message(), "ts_raw": json_timestamp_pick()})
        .filter(F.col("_log").isNotNull())
        .select("source_file", "_path", "_block", "ts_raw", F.col("_log").alias("_message"), *[F.col(n).cast("string").alias(n) for n in kept])
        .withColumnRenamed("_message", "log")
    )
    return _number_lines(rows).withColumn("ts", parsed_time(F.col("ts_raw"))).select(*LOG_COLUMNS, *kept)


def scan_logs(spark: SparkSession, path: str, json_layout: str = "array") -> DataFrame:
    """All ``.json``, ``.log`` and ``.txt`` files of a folder (or one file) as one table."""
    parts = []
    if _has_files(spark, path, "*.{log,txt}"):
        parts.append(scan_text_logs(spark, path, "*.{log,txt}"))
    if _has_files(spark, path, "*.json"):
        parts.append(scan_json_logs(spark, path, "*.json", layout=json_layout))
    if not parts:
        return spark.createDataFrame([], "source_file string, line_no long, ts_raw string, ts timestamp, log string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _has_files(spark: SparkSession, path: str, glob: str = "*") -> bool:
    """Whether the folder (or the one file) has a name like ``glob``. Only the answer reaches Python, not the names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return False
    if fs.getFileStatus(where).isFile():
        return hadoop.GlobFilter(glob).accept(where)
    found = fs.globStatus(hadoop.Path(where, glob))
    return found is not None and len(found) > 0


def cap_rows_per_file(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` lines of every file."""
    return df if limit is None else df.filter(F.col("line_no") <= limit)


def large_file_flag(df: DataFrame, threshold: int = 100_000, cap: int | None = None) -> DataFrame:
    """Per file: rows before the cap, rows kept, and whether the kept rows exceed the threshold."""
    kept = F.col("original_count") if cap is None else F.least(F.col("original_count"), F.lit(cap))
    return (
        df.groupBy("source_file").agg(F.count(F.lit(1)).alias("original_count"))
        .withColumn("kept_count", kept).withColumn("is_large", F.col("kept_count") > threshold)
    )


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Lines known to be fine: ``source_file, log``; a bad or missing file means none."""
    if not _has_files(spark, path):
        return spark.createDataFrame([], "source_file string, log string")
    entry = F.col("log")
    return (
        _json_records(spark, path, None, ["log"], "array")
        .filter(F.schema_of_variant(entry) == "STRING").select("source_file", entry.cast("string").alias("log"))
    )


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATE_SCHEMA).json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Anomaly or summary table as written; give the schema to skip inference on large tables."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)
