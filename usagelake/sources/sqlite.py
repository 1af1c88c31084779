"""Session databases of the fourth harness. Files come through Spark's binary reader, so from any store; a task opens one in memory."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.location import session_locations
from .sanitize import is_usage, sanitize

_NAME = r"^opencode(-[\w.-]+)?\.db$"
#: Tables, the format that each has, and the columns taken as they are. The first two hold a data column as well.
TABLES = {
    "message": ("opencode-v1", ("id", "session_id", "time_created")), "session_message": ("opencode-v2", ("id", "session_id", "type", "time_created")),
    "session": ("opencode-session", ("id", "directory", "project_id")), "project": ("opencode-project", ("id", "vcs")),
}


def _opened(content: bytes) -> sqlite3.Connection:
    """The database as its file has it. A file in write-ahead mode says so in its header, which memory doesn't know; what
    hasn't been moved from the log to the file yet isn't read."""
    db = sqlite3.connect(":memory:")
    db.deserialize(content[:18] + b"\x01\x01" + content[20:])
    return db


def rows(spark: SparkSession, root: str) -> DataFrame:
    """(path, format, ordinal, value): each row of the tables as JSON text. Tables and columns that a file lacks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                db = _opened(content)
                for table, (format_, columns) in TABLES.items():
                    there = [c[1] for c in db.execute(f"PRAGMA table_info({table})")]
                    taken, data = [c for c in columns if c in there], format_ in ("opencode-v1", "opencode-v2")
                    if "id" not in there or (data and "data" not in there):
                        continue
                    for n, (inner, *values) in enumerate(db.execute(f"SELECT {'data' if data else 'NULL'}, {', '.join(taken)} FROM {table} ORDER BY rowid"), 1):
                        try:
                            own = {"data": json.loads(inner)} if data else {}
                        except (TypeError, ValueError):
                            continue
                        out.append((path, format_, n, json.dumps(dict(zip(taken, values, strict=True)) | own)))
                db.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["path", "format", "ordinal", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "opencode*.db").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.rlike(_NAME)).select(name.alias("path"), "content").mapInArrow(run, "path string, format string, ordinal long, value string")


def evidence(spark: SparkSession, root: str, home: str = "") -> DataFrame:
    """Usage records with the locations of their sessions."""
    found = rows(spark, root)
    clean = sanitize(found.where("format IN ('opencode-v1', 'opencode-v2')"), "opencode").where(F.col("data").isNotNull())
    none = F.array().cast("array<struct<ordinal:bigint,data:string,diagnostics:array<string>>>")
    usage = clean.where(is_usage(F.lit("opencode"), F.col("format"), F.col("data"))).select(
        F.lit("opencode").alias("harness"), "format", F.sha2(F.to_json(F.array(F.lit("opencode"), F.col("path"))), 256).alias("source_id"), F.lit("0").alias("lineage"), "ordinal", "data", none.alias("context"), "diagnostics", F.lit(True).alias("is_usage"),
        F.concat_ws("/", "path", F.get_json_object("data", "$.session_id")).alias("__session"),
    )
    at = lambda p: F.get_json_object("value", f"$.{p}")
    in_file = lambda c: F.concat_ws("/", "path", c)
    sessions = found.where("format = 'opencode-session'").select(in_file(at("id")).alias("id"), at("directory").alias("directory"), in_file(at("project_id")).alias("project_id"), at("project_id").alias("project"))
    projects = found.where("format = 'opencode-project'").select(in_file(at("id")).alias("id"), at("vcs").alias("vcs"))
    return session_locations(usage, sessions, projects, "__session", home).drop("__session")
