"""Tables that cut a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: While it holds, a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_results: list[tuple[SparkSession, str]] = []


def _folder(df: DataFrame) -> SparkContext:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return context


def kept(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read from there: later stages restart from files that outlive any executor, and
    what reads it several times computes it once. Where the setting is missing, a folder of this machine will do only if
    there is no other."""
    _folder(df)
    return df.checkpoint()


def _remove(folders: list[tuple[SparkSession, str]]) -> None:
    for spark, path in folders:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for folder in _results:
        try:
            _remove([folder])
        except Exception:  # the JVM may have ended already; nothing else is at stake here
            return


def _written(df: DataFrame, label: str, by: tuple[str, ...], into: list[tuple[SparkSession, str]]) -> DataFrame:
    spark, path = df.sparkSession, f"{_folder(df).getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    into.append((spark, path))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Like kept, for results that grow with the input: compressed columns, of which later stages read what they need, and no shuffle
    file is left behind. The folder is removed when the driver's Python ends."""
    return _written(df, "stored", (), _results)


class Scratch:
    """`with Scratch() as own`: tables that are removed at the end of the block, where nothing is computed from them any more."""

    def __init__(self) -> None:
        self._folders: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def clear(self) -> None:
        _remove(self._folders)
        self._folders = []

    def stored(self, df: DataFrame) -> DataFrame:
        return _written(df, "scratch", (), self._folders)

    def dealt(self, df: DataFrame, column: str) -> DataFrame:
        """In a folder for each value of the column, which should have few: a filter on it reads that folder only."""
        return _written(df, column, (column,), self._folders)
