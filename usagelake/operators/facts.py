"""Resolved candidates as rows of the fact tables, checked as a whole.

A fact table is written once (partitioned by dataset, generation and day, sorted by time within), and dashboard queries read
it: their ranges and filters then prune files and row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ESTIMATE, FACT, HARNESSES, LAST_MS, SAFE_INTEGER, TOKENS, same_layout

LOCATION = ("directory_key", "directory_name", "repository_key", "repository_name", "repository_source")
#: What a record's usage is of; the only one there is now.
SCOPE = "message"
PROVIDER_SOURCES, QUALITIES = ("explicit", "inferred", "unknown"), ("exact", "derived", "estimated")
MOST_STRING_BYTES = 256


def _text(c: Column, required: bool = False) -> Column:
    fine = (F.octet_length(c) <= MOST_STRING_BYTES) & ~c.rlike(r"\p{Cc}")
    return fine & (F.trim(c) != "") if required else fine


def countable(scope: Column) -> Column:
    """Usage that stands in for other usage isn't counted."""
    return ~F.contains(scope, F.lit("fallback"))


def valid() -> Column:
    """Whether a candidate's columns make a fact; null counts as no."""
    c = F.col
    tests = [
        c("harness").isin(*HARNESSES), _text(c("session_native_id"), True), c("occurred_at_ms").between(0, LAST_MS), _text(c("request_id")), _text(c("message_native_id"), True), c("usage_scope") == SCOPE,
        _text(c("provider"), True), _text(c("model"), True), c("provider_source").isin(*PROVIDER_SOURCES), c("quality").isin(*QUALITIES), *(c(t).between(0, SAFE_INTEGER) for t in TOKENS), c("total_tokens").between(0, SAFE_INTEGER),
        c("total_tokens") == sum((c(t) for t in TOKENS[1:]), c(TOKENS[0])), *(_text(c(x)) for x in LOCATION), ~F.concat("directory_name", "repository_name").rlike(r"[/\\]"),
        (c("directory_key") != "") | (c("directory_name") == ""), (c("repository_key") != "") | ((c("repository_name") == "") & (c("repository_source") == "")),
    ]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return F.coalesce(out, F.lit(False))


def session_scope(harness: Column, session: Column) -> Column:
    return F.concat(harness, F.lit(":session:"), session)


def _rows(resolved: DataFrame, dataset: str, generation: int, revision: int, *more: str) -> DataFrame:
    payload = ("fact_id", "harness", "session_native_id", "message_native_id", "request_id", "occurred_at_ms", "provider", "provider_source", "model", "usage_scope", "quality", *TOKENS, "total_tokens", *LOCATION)
    made = {
        "dataset_id": F.lit(dataset), "scope": session_scope(F.col("harness"), F.col("session_native_id")), "native_request_id": F.col("request_id"), "countable": countable(F.col("usage_scope")),
        "payload_json": F.to_json(F.struct(*payload)), "generation": F.lit(generation).cast("bigint"), "input_revision": F.lit(revision).cast("bigint"),
    }
    return resolved.select(*(made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in FACT.fields), *more)


def fact_rows(contributions: DataFrame, dataset: str = "default", generation: int = 1, revision: int = 0) -> DataFrame:
    """Confirmed facts in FACT's columns."""
    return _rows(contributions, dataset, generation, revision)


def estimate_rows(estimates: DataFrame, dataset: str = "default", generation: int = 1, revision: int = 0) -> DataFrame:
    """Estimates in ESTIMATE's columns: facts with their evidence and the reason."""
    return _rows(estimates, dataset, generation, revision, "evidence_id", "reason_code")


def write_facts(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes fact or estimate rows as a table that read_facts takes: one folder for each dataset, generation and UTC day."""
    if differs := min(same_layout(rows.schema, FACT), same_layout(rows.schema, ESTIMATE), key=len):
        raise ValueError(f"not a fact table: {', '.join(differs)}")
    day = F.date_format(F.timestamp_millis("occurred_at_ms"), "yyyy-MM-dd")
    keys = ["dataset_id", "generation", "day"]
    # Ranges of time, not a hash of the day: a busy day is dealt out over several tasks and files.
    dealt = rows.withColumn("day", day).repartitionByRange(*keys, "occurred_at_ms").sortWithinPartitions(*keys, "occurred_at_ms")
    dealt.write.mode(mode).partitionBy(*keys).parquet(path)


def read_facts(spark: SparkSession, path: str, dataset: str = "default", generation: int = 1, estimated: bool = False) -> DataFrame:
    """One dataset's generation; time ranges should be given with in_days to skip folders too."""
    schema = ESTIMATE if estimated else FACT
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = spark.read.schema(f"{fields}, day string").parquet(path)
    return rows.where((F.col("dataset_id") == dataset) & (F.col("generation") == generation))


def in_days(rows: DataFrame, start_ms: int | None, end_ms: int | None) -> DataFrame:
    """rows of a table from read_facts in the days that [start, end) touches."""
    as_day = lambda ms: F.date_format(F.timestamp_millis(F.lit(ms).cast("bigint")), "yyyy-MM-dd")
    if start_ms is not None:
        rows = rows.where(F.col("day") >= as_day(start_ms))
    if end_ms is not None:
        rows = rows.where(F.col("day") <= as_day(end_ms))
    return rows
