"""Session files that grow: only what has been appended since the last scan is read.

How far a file has been read is a cursor: bytes, number of lines, a hash of these bytes, a lineage, and what later records need
of earlier ones (context and location, sanitized). Cursors are a table, joined with a listing of the files; files whose size or
time has changed are read in tasks, each by one. A file whose first bytes aren't what they were (rewritten or cut off) begins
anew under another lineage. A last line without its end is evidence if it is whole JSON, but the cursor stays before it.

No byte of a file is written anywhere before it is sanitized. A source with a line that is too long and may matter fails alone:
nothing of this scan of it counts, its cursor stays, and it isn't read again until it (or the parser) changes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.facts import LOCATION
from ..operators.location import located
from ..storage import kept
from .jsonl import MOST_LINE_BYTES, SOURCES, file_globs, source_id
from .longlines import LineJudge
from .sanitize import CONTEXT_KINDS, context_kind, is_usage, sanitize

#: Raised when other lines count or fail than before: sources that failed are then tried again.
PARSER = 1
CHUNK = 1 << 20
CONTEXT = "array<struct<ordinal:bigint,data:string,diagnostics:array<string>>>"
PLACE = f"struct<{','.join(f'{c}:string' for c in LOCATION)}>"
CURSOR = f"source_id string, lineage string, offset long, ordinal long, prefix string, modified timestamp, length long, context {CONTEXT}, place {PLACE}"
FAILURE = "source_id string, modified timestamp, length long, parser int, code string, offset long"
_READ = "source_id string, lineage string, row string, ordinal long, value string, offset long, prefix string"


@dataclass(frozen=True)
class Scan:
    """evidence: of this scan's lines. cursors and failures: the whole tables that the next scan takes."""

    evidence: DataFrame
    cursors: DataFrame
    failures: DataFrame


def read_tail(f: BinaryIO, harness: str, offset: int, ordinal: int, prefix: str, most: int = MOST_LINE_BYTES) -> Iterator[tuple[str, int, bytes, int, str]]:
    """(row, ordinal, line, offset, prefix): `anew` first if the file isn't what it was; `line` for each line; `tail` for a whole last
    line without end; at last `cursor`, or `failed` with the place of a line that is too long."""
    digest, left = hashlib.sha256(), offset
    while left and (data := f.read(min(CHUNK, left))):
        digest.update(data)
        left -= len(data)
    if offset and (left or digest.hexdigest() != prefix):
        f.seek(0)
        digest, offset, ordinal = hashlib.sha256(), 0, 0
        yield "anew", 0, b"", 0, ""
    line, judge, before, length = bytearray(), None, digest, 0
    while data := f.read(CHUNK):
        at = 0
        while at < len(data):
            end = data.find(b"\n", at) + 1 or len(data)
            piece, at = data[at:end], end
            if judge is None and len(line) + len(piece) > most:
                judge, before, length = LineJudge(), digest.copy(), 0
                piece, line = bytes(line) + piece, bytearray()
            if judge is None:
                line += piece
            else:
                judge.feed(piece)
                digest.update(piece)
                length += len(piece)
            if not piece.endswith(b"\n"):
                continue
            if judge is not None and not judge.irrelevant(harness):
                yield "failed", ordinal + 1, b"", offset, ""
                return
            ordinal += 1
            offset += length if judge is not None else len(line)
            if judge is None:
                digest.update(line)
                yield "line", ordinal, bytes(line), offset, ""
            line, judge = bytearray(), None
    if judge is not None:  # a long line without end: it may still grow, unless it is whole and matters
        if judge.sound() and not judge.irrelevant(harness):
            yield "failed", ordinal + 1, b"", offset, ""
            return
        digest = before
    elif line and _whole(line):
        yield "tail", ordinal + 1, bytes(line), offset, ""
    yield "cursor", ordinal, b"", offset, digest.hexdigest()


def _whole(line: bytearray) -> bool:
    try:
        json.loads(line, parse_constant=_no_constant)
    except ValueError:
        return False
    return True


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _open(path: str) -> BinaryIO:
    from pyarrow import fs

    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path.replace("s3a://", "s3://", 1)
    store, inside = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inside)


def _files(spark: SparkSession, harness: str, root: str, whole: bool) -> DataFrame:
    """(source_id, path, modified, length): the listing only, no file is opened."""
    globs, recursive = file_globs(spark, harness, root, whole)
    if not globs:
        return spark.createDataFrame([], "source_id string, path string, modified timestamp, length long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(globs)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(name.rlike(SOURCES[harness].name_pattern) & ~F.col("path").rlike(r"/(\.git|node_modules)/")).select(source_id(harness, root, F.col("path")).alias("source_id"), "path", F.col("modificationTime").alias("modified"), "length")


def scan(spark: SparkSession, harness: str, root: str, cursors: DataFrame | None = None, failures: DataFrame | None = None, home: str = "", most: int = MOST_LINE_BYTES, whole: bool = False) -> Scan:
    """What has come to the harness's files since the scan that gave cursors and failures."""
    cursors = cursors if cursors is not None else spark.createDataFrame([], CURSOR)
    failures = failures if failures is not None else spark.createDataFrame([], FAILURE)
    signature = ["source_id", "modified", "length"]
    files = _files(spark, harness, root, whole).join(cursors.select(*signature), signature, "left_anti").join(failures.where(F.col("parser") == PARSER).select(*signature), signature, "left_anti")
    changed = kept(files.join(cursors.select("source_id", "lineage", "offset", "ordinal", "prefix"), "source_id", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                lineage, rows, size = f["lineage"] or _next_lineage(f["source_id"], ""), [], 0
                with _open(f["path"]) as stream:
                    for row, ordinal, line, offset, prefix in read_tail(stream, harness, f["offset"] or 0, f["ordinal"] or 0, f["prefix"] or "", most):
                        if row == "anew":
                            lineage = _next_lineage(f["source_id"], lineage)
                            continue
                        rows.append((f["source_id"], lineage, row, ordinal, line.decode(errors="replace") if line else None, offset, prefix))
                        size += len(line)
                        if size > 4 * CHUNK:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    read = changed.select("source_id", "path", "lineage", "offset", "ordinal", "prefix").repartition("source_id").mapInArrow(run, _READ)
    h, inner = F.lit(harness), "payload." if harness == "codex" else ""
    at = lambda p: F.nullif(F.get_json_object("value", f"$.{p}"), F.lit(""))
    remote = F.coalesce(at("payload.git.repository_url"), at("payload.git.origin_url")) if harness == "codex" else F.lit(None).cast("string")
    clean = sanitize(read, harness).select(
        "source_id", "lineage", "row", "ordinal", "offset", "prefix", "data", "diagnostics", context_kind(h, F.col("data")).alias("kind"), is_usage(h, F.lit("jsonl"), F.col("data")).alias("is_usage"),
        at(f"{inner}cwd").alias("__directory"), remote.alias("__remote"),
    )
    placed = located(clean, "__directory", "__remote", home=home).withColumn("place", F.when(F.col("__directory").isNotNull(), F.struct(*LOCATION)))
    rows = kept(placed.drop("__directory", "__remote", "location_conflict", *LOCATION).where("row in ('cursor', 'failed') or is_usage or kind is not null"))
    failed = rows.where("row = 'failed'").select("source_id", "offset").join(changed.select(*signature), "source_id")
    ends = rows.where("row = 'cursor'").select("source_id", "lineage", "offset", "ordinal", "prefix")
    lines = rows.where("row in ('line', 'tail')").join(ends.select("source_id"), "source_id", "left_semi")
    return Scan(_evidence(lines, _carried(cursors, ends), harness), _cursors(cursors, ends, lines, changed, harness), _failures(failures, failed, changed))


def _next_lineage(source: str, lineage: str) -> str:
    """Another run gives the same one."""
    return hashlib.sha256(f"{source}\n{lineage}".encode()).hexdigest()[:32]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["source_id", "lineage", "row", "ordinal", "value", "offset", "prefix"])


def _carried(cursors: DataFrame, ends: DataFrame) -> DataFrame:
    """Cursors of the files that go on under the same lineage."""
    return cursors.join(ends.select("source_id", "lineage"), ["source_id", "lineage"], "left_semi")


def _evidence(lines: DataFrame, carried: DataFrame, harness: str) -> DataFrame:
    """Usage and context records in the columns of evidence, with the latest context and location before them, of earlier scans too."""
    h = F.lit(harness)
    old = carried.select("source_id", "lineage", F.explode("context").alias("c")).select("source_id", "lineage", "c.*").withColumns({"kind": context_kind(h, F.col("data")), "is_usage": F.lit(False), "place": F.lit(None).cast(PLACE)})
    where = carried.where("place is not null").select("source_id", "lineage", "ordinal", "place")
    own = lines.select("source_id", "lineage", "ordinal", "data", "diagnostics", "kind", "is_usage", "place", F.lit(True).alias("__own"))
    rows = own.unionByName(old, allowMissingColumns=True).unionByName(where, allowMissingColumns=True)
    before = Window.partitionBy("source_id", "lineage").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("kind") == k, F.struct("ordinal", "data", "diagnostics")), ignorenulls=True).over(before) for k in CONTEXT_KINDS.get(harness, ())]
    context = F.array_sort(F.array_compact(F.array(*last))) if last else F.array().cast(CONTEXT)
    place = F.last("place", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.select("__own", h.alias("harness"), F.lit("jsonl").alias("format"), "source_id", "lineage", "ordinal", "data", context.alias("context"), "diagnostics", "is_usage", place.alias("__place"))
    return found.where("__own").select("harness", "format", "source_id", "lineage", "ordinal", "data", "context", "diagnostics", "is_usage", *(F.coalesce(F.col(f"__place.{c}"), F.lit("")).alias(c) for c in LOCATION))


def _cursors(cursors: DataFrame, ends: DataFrame, lines: DataFrame, changed: DataFrame, harness: str) -> DataFrame:
    kinds = CONTEXT_KINDS.get(harness, ())
    one = F.struct("ordinal", "data", "diagnostics")
    latest = lines.where("row = 'line'").groupBy("source_id").agg(*(F.max_by(F.when(F.col("kind") == k, one), F.when(F.col("kind") == k, F.col("ordinal"))).alias(f"__{k}") for k in kinds), F.max_by("place", F.when(F.col("place").isNotNull(), F.col("ordinal"))).alias("__place"))
    before = _carried(cursors, ends).select("source_id", F.col("context").alias("__old"), F.col("place").alias("__old_place"))
    old = lambda k: F.try_element_at(F.filter("__old", lambda c: context_kind(F.lit(harness), c["data"]) == k), F.lit(-1))
    context = F.array_sort(F.array_compact(F.array(*(F.coalesce(f"__{k}", old(k)) for k in kinds)))) if kinds else F.array()
    new = ends.join(changed.select("source_id", "modified", "length"), "source_id").join(latest, "source_id", "left").join(before, "source_id", "left")
    new = new.select("source_id", "lineage", "offset", "ordinal", "prefix", "modified", "length", context.cast(CONTEXT).alias("context"), F.coalesce("__place", "__old_place").alias("place"))
    return kept(cursors.join(ends.select("source_id"), "source_id", "left_anti").unionByName(new))


def _failures(failures: DataFrame, failed: DataFrame, changed: DataFrame) -> DataFrame:
    new = failed.select("source_id", "modified", "length", F.lit(PARSER).alias("parser"), F.lit("record_limit").alias("code"), "offset")
    return kept(failures.join(changed.select("source_id"), "source_id", "left_anti").unionByName(new))
