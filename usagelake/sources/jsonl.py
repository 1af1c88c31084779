"""JSON-lines session files of three harnesses as evidence rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.location import located
from .sanitize import CONTEXT_KINDS, context_kind, is_usage, sanitize

MOST_LINE_BYTES = 16 << 20


@dataclass(frozen=True)
class Source:
    """Where a harness keeps its files below its root. recursive: at any depth; else in the root and one level below."""

    harness: str
    folders: tuple[str, ...]
    recursive: bool
    name_pattern: str


SOURCES = {
    "pi": Source("pi", ("",), False, r"\.(jsonl|ndjson)$"),
    "codex": Source("codex", ("sessions", "archived_sessions"), True, r"^rollout-.*\.jsonl$"),
    "claude-code": Source("claude-code", ("projects",), True, r"\.jsonl$"),
}


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) is not None and len(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)) > 0


def file_globs(spark: SparkSession, harness: str, root: str, whole: bool = False) -> tuple[list[str], bool]:
    """(where there are files, whether at any depth). whole: in the root itself, not in the harness's folders below it."""
    source = SOURCES[harness]
    if source.recursive:
        return [p for f in (("",) if whole else source.folders) if _exists(spark, p := f"{root}/{f}")], True
    return [p for x in ("*.jsonl", "*.ndjson", "*/*.jsonl", "*/*.ndjson") if _exists(spark, p := f"{root}/{x}")], False


def lines(spark: SparkSession, harness: str, root: str, whole: bool = False) -> DataFrame:
    """(path, ordinal, value): the lines of the harness's files; ordinals rise within a file."""
    source = SOURCES[harness]
    paths, recursive = file_globs(spark, harness, root, whole)
    reader = spark.read.option("recursiveFileLookup", "true") if recursive else spark.read
    if not paths:
        return spark.createDataFrame([], "path string, ordinal long, value string")
    name, path = F.element_at(F.split("_metadata.file_path", "/"), -1), F.col("_metadata.file_path")
    rows = reader.text(paths).select(path.alias("path"), F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_block_start").alias("block"), name.alias("name"))
    kept = rows.where(F.col("name").rlike(source.name_pattern) & ~F.col("path").rlike(r"/(\.git|node_modules)/"))
    # Lines keep their order within a block of a file, and blocks have an offset: numbers follow from both.
    place = Window.partitionBy("path").orderBy("block", "at")
    return kept.select("path", F.row_number().over(place).cast("long").alias("ordinal"), "value")


def oversized(df: DataFrame) -> DataFrame:
    """Sources with a line beyond the limit: they are set aside as a whole."""
    return df.where(F.octet_length("value") > MOST_LINE_BYTES).select("path").distinct()


def source_id(harness: str, root: str, path: Column) -> Column:
    """A hash of the path below the root, so that evidence moves with its folder."""
    inside = root.rstrip("/") + "/"
    at = F.instr(path, inside)
    below = F.when(at > 0, F.substr(path, at + len(inside))).otherwise(path)
    return F.sha2(F.to_json(F.array(F.lit(harness), below)), 256)


def evidence(spark: SparkSession, harness: str, root: str, home: str = "", whole: bool = False) -> DataFrame:
    """Usage and context records with the latest context of each kind before them, and the location of the latest record up to
    them that names a directory. The directory itself goes no further."""
    raw = lines(spark, harness, root, whole)
    fit = raw.join(oversized(raw), "path", "left_anti").where(F.trim("value") != "")
    clean = sanitize(fit, harness).where(F.col("data").isNotNull())
    h = F.lit(harness)
    at = lambda p: F.nullif(F.get_json_object("value", f"$.{p}"), F.lit(""))
    inner = "payload." if harness == "codex" else ""
    remote = F.coalesce(at("payload.git.repository_url"), at("payload.git.origin_url")) if harness == "codex" else F.lit(None).cast("string")
    rows = clean.select(
        F.when(at(f"{inner}cwd").isNotNull(), F.struct(at(f"{inner}cwd").alias("directory"), remote.alias("remote"))).alias("place"), h.alias("harness"), F.lit("jsonl").alias("format"), source_id(harness, root, F.col("path")).alias("source_id"), F.lit("0").alias("lineage"), "ordinal", "data", "diagnostics",
        context_kind(h, F.col("data")).alias("kind"), is_usage(h, F.lit("jsonl"), F.col("data")).alias("is_usage"),
    ).where("is_usage or kind is not null")
    before = Window.partitionBy("source_id", "lineage").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    kinds = CONTEXT_KINDS.get(harness, ())
    last = [F.last(F.when(F.col("kind") == k, F.struct("ordinal", "data", "diagnostics")), ignorenulls=True).over(before) for k in kinds]
    context = F.array_sort(F.array_compact(F.array(*last))) if kinds else F.array().cast("array<struct<ordinal:bigint,data:string,diagnostics:array<string>>>")
    place = F.last("place", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.select("harness", "format", "source_id", "lineage", "ordinal", "data", context.alias("context"), "diagnostics", "is_usage", place["directory"].alias("__directory"), place["remote"].alias("__remote"))
    return located(out, "__directory", "__remote", home=home).drop("__directory", "__remote", "location_conflict")


def all_evidence(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Evidence of all harnesses that have a root."""
    return reduce(DataFrame.unionByName, [evidence(spark, h, root) for h, root in roots.items()])
