"""Resolution of candidate facts: one fact for each identity, with conflicts, outcomes and routing.

Candidates: fact_id, harness, format, occurred_at_ms, evidence_id, request_id, payload_hash (of what may not differ
between equal records), code (empty: clean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_FACT = ("known_duplicate", "stale_snapshot")


def resolve(candidates: DataFrame) -> DataFrame:
    """Candidates with is_selected, conflict, disposition and outcome_code. One shuffle on fact_id serves all windows."""
    group = Window.partitionBy("fact_id")
    second = (F.col("harness") == "opencode") & (F.col("format") == "opencode-v2")
    # The latest clean candidate, else the latest; a second-format row of its harness before all.
    rank = F.struct(second.cast("int").alias("second"), F.when(second, F.lit(0)).otherwise((F.col("code") == "").cast("int")).alias("clean"), "occurred_at_ms", "evidence_id")
    rows = candidates.withColumn("__best", F.max(F.struct(rank.alias("rank"), "payload_hash", "format", "harness", "request_id", "code", F.col("occurred_at_ms").alias("ms"))).over(group))
    best = F.col("__best")
    selected = best["rank"]["evidence_id"] == F.col("evidence_id")
    older_format = (best["harness"] == "opencode") & (best["format"] == "opencode-v2") & (F.col("format") == "opencode-v1")
    revision = (best["harness"] == "claude-code") & (best["request_id"] != "") & (F.col("occurred_at_ms") != best["ms"])
    differs = (F.col("code") == "") & ~older_format & ~revision & (F.col("payload_hash") != best["payload_hash"])
    rows = rows.withColumn("conflict", F.max(differs).over(group)).withColumn("is_selected", selected)
    c = F.col("code")
    earlier = (F.col("occurred_at_ms") < best["ms"]) | (F.col("format") != best["format"])
    disposition = (
        F.when(F.col("conflict"), "ambiguous").when(c == "known_duplicate", "duplicate").when(c == "stale_snapshot", "superseded").when(c != "", "ambiguous")
        .when(F.col("is_selected"), "processed").when(earlier, "superseded").otherwise("duplicate")
    )
    code = F.when(F.col("conflict"), "conflicting_native_identity").when(c.isin(*NO_FACT), "").otherwise(c)
    return rows.withColumn("disposition", disposition).withColumn("outcome_code", code).drop("__best")


def contributions(resolved: DataFrame) -> DataFrame:
    """The selected candidates that are clean: confirmed facts."""
    return resolved.where(F.col("is_selected") & ~F.col("conflict") & (F.col("code") == ""))


def estimates(resolved: DataFrame) -> DataFrame:
    """The selected candidates with a reason why they aren't confirmed."""
    reason = F.when(F.col("conflict"), "conflicting_native_identity").otherwise(F.col("code"))
    return resolved.where("is_selected").withColumn("reason_code", reason).where(~F.col("reason_code").isin("", *NO_FACT))


def provenance(resolved: DataFrame) -> DataFrame:
    """(fact_id, evidence_id) of all members of confirmed facts' groups."""
    return resolved.join(contributions(resolved).select("fact_id"), "fact_id", "left_semi").select("fact_id", "evidence_id").distinct()


def ambiguity(missing_identity: Column, bad_counters: Column, bad_fields: Column, conflicting: Column) -> Column:
    """The last of these that holds gives the code."""
    return F.when(conflicting, "conflicting_native_fields").when(bad_fields, "invalid_source_fields").when(bad_counters, "invalid_source_counters").when(missing_identity, "missing_native_identity").otherwise("")
