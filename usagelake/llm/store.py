"""Tables that cut a job's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[tuple[SparkSession, str]] = []
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset (tests on one machine) a temporary one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def scratch() -> Iterator[None]:
    """Folders that are made inside are removed at the end, but for those made as results (of the scope outside)."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for spark, path in stack.pop():
            drop_folder(spark, path)


def new_folder(spark: SparkSession, label: str, result: bool = False) -> str:
    """A fresh path in the shared folder, removed with the scratch scope it is made in, or else when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    inside = [_own, *_scopes.__dict__.get("stack", [])]
    inside[-2 if result and len(inside) > 1 else -1].append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _own:
        try:
            drop_folder(spark, path)
        except Exception:  # the JVM may have ended already; nothing else is at stake here
            return


def cut(df: DataFrame, label: str, result: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later stages restart from files that outlive any executor. result: it is
    read outside the scratch scope that makes it."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, label, result)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
