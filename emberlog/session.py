"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Rows of a file of an intermediate table. A table of a few groups leaves few tasks; in files of this size the next stage reads it with all cores.
FILE_ROWS = 100_000
# Columns in memory over their share of a file: log tables hold much that is repeated. Spark takes a file's size for that of its rows otherwise.
IN_MEMORY = 16


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own; on a
    cluster a machine-local folder would be lost with the executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="emberlog-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


_owned: ContextVar[list[str] | None] = ContextVar("paths of this run", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses; inside ``run_scope`` it belongs to the run."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if (mine := _owned.get()) is not None:
        mine.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the copy."""
    spark = df.sparkSession
    shared_folder(spark)
    cut = df.checkpoint(eager=True)
    if (mine := _owned.get()) is not None:  # the folder is known by the number of the checkpointed RDD only
        file = cut._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            mine.append(file.get())
    return cut


def written(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage`` as a columnar table: for wide tables that several later
    steps read a few columns of."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StageTable:
    """A table that goes from stage to stage: each ``put`` writes the next state and deletes the one before.

    Whatever reads an earlier state must have been computed by then. So there are two copies while a stage runs, and one between stages.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.path = spark, label, None

    def put(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, scratch_path(self.spark, self.label)
        df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(self.path)
        if before is not None:
            _delete(self.spark, [before])
        return self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the table once nothing reads it any more."""
        _delete(self.spark, [self.path])


def prepare(spark: SparkSession) -> None:
    """What the operators count on: times without a zone are UTC, and plans adapt to the sizes met
    (joins of hot keys with one row per key are split). A table counts with the size of its rows, not of its compressed file: one of
    a million rows would pass for small and be sent through the driver whole."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(IN_MEMORY))


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Owns the intermediate tables of a run: the paths that it takes inside the block are deleted at its end, and no others, so
    runs of several threads may share the folder.

    Results that are read lazily from such tables must have been written elsewhere by then.
    """
    paths: list[str] = []
    token = _owned.set(paths)
    try:
        yield
    finally:
        _owned.reset(token)
        _delete(spark, paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = path_of(name)
        path.getFileSystem(conf).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: dict[str, str] = {}


def ship(spark: SparkSession, *folders: str) -> None:
    """Give the Python workers these source folders, for a library that is not installed there.

    Same as ``spark-submit --py-files``; done once per application.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="emberlog-py-"), "emberlog_sources.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder in folders:
            top = os.path.dirname(os.path.abspath(folder))
            for here, _, names in os.walk(folder):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(here, name)
                        out.write(path, os.path.relpath(path, top))
    spark.sparkContext.addPyFile(archive)
    _shipped[app] = archive
