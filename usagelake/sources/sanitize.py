"""Whitelisted metadata out of native JSON records.

from_json with a fixed schema keeps only what is listed, and the last of duplicate keys. A leaf that holds an object or
array, unsafe text or too much text becomes null and leaves a diagnostic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_metadata
from ..schemas import HARNESSES

#: The leaves that each harness's records may keep.
LEAVES = {
    "pi": ["type", "id", "timestamp", "message.role", "message.provider", "message.model", "message.timestamp", "message.usage.input", "message.usage.output", "message.usage.reasoning", "message.usage.cacheRead", "message.usage.cacheWrite", "message.usage.totalTokens"],
    "claude-code": ["type", "timestamp", "uuid", "sessionId", "session_id", "requestId", "request_id", "message.role", "message.id", "message.provider", "message.provider_id", "message.providerID", "message.model", "message.model_id", "message.modelID", "message.usage.input_tokens", "message.usage.output_tokens", "message.usage.cache_read_input_tokens", "message.usage.cache_creation_input_tokens", "message.usage.total_tokens", "message.usage.output_tokens_details.thinking_tokens", "message.usage.output_tokens_details.reasoning_tokens"],
    "codex": ["timestamp", "type", "payload.type", "payload.id", "payload.turn_id", "payload.model", "payload.model_provider", "payload.forked_from_id", "payload.parent_thread_id", "payload.source.subagent.thread_spawn.parent_thread_id", *(f"payload.info.{s}.{c}" for s in ("last_token_usage", "total_token_usage") for c in ("input_tokens", "cached_input_tokens", "cache_read_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"))],
    "opencode": ["id", "session_id", "type", "time_created", "data.role", "data.providerID", "data.modelID", "data.model.providerID", "data.model.id", *(f"data.tokens.{c}" for c in ("input", "output", "reasoning", "cache.read", "cache.write")), "data.time.created", "data.time.completed"],
}


def _tree(paths: list[str]) -> dict:
    out: dict = {}
    for path in paths:
        at = out
        for part in path.split("."):
            at = at.setdefault(part, {})
    return out


def _ddl(tree: dict) -> str:
    return "STRUCT<" + ", ".join(f"`{k}`: {_ddl(v) if v else 'STRING'}" for k, v in tree.items()) + ">"


def schema_of(harness: str) -> str:
    """All leaves as text: numbers keep their digits, and null, absent and wrong shapes can be told apart afterwards."""
    return _ddl(_tree(LEAVES[harness]))


def parsed(json: Column, harness: str) -> Column:
    return F.from_json(json, schema_of(harness), {"mode": "PERMISSIVE"})


def sanitize(df: DataFrame, harness: str, json_col: str = "value") -> DataFrame:
    """df with data (JSON text of the listed leaves; null: not an object) and diagnostics (sorted codes). The leaves are judged as one
    array, so that the expression doesn't grow with their number."""
    leaves = LEAVES[harness]
    place = {path: i for i, path in enumerate(leaves)}
    out = df.withColumn("__r", parsed(F.col(json_col), harness)).withColumn("__all", F.expr(f"array({', '.join(f'__r.{path}' for path in leaves)})"))
    flaw = lambda v: F.when(v.rlike(r"^\s*[\[{]"), "invalid_field_type").when(F.octet_length(v) > 256, "field_limit").when(v.isNotNull() & ~safe_metadata(v), "unsafe_metadata")
    out = out.withColumn("__flaws", F.transform("__all", flaw))

    def build(tree: dict, prefix: str = "") -> str:
        fields = (f"'{k}', {build(v, f'{prefix}{k}.') if v else f'IF(__flaws[{place[prefix + k]}] IS NULL, __all[{place[prefix + k]}], NULL)'}" for k, v in tree.items())
        return f"named_struct({', '.join(fields)})"

    notes = F.array_compact("__flaws")
    if harness == "codex":
        notes = F.concat(notes, F.array_compact(F.array(F.when(F.get_json_object(json_col, "$.payload.source.subagent").isNotNull(), "native_subagent_present"))))
    data = F.when(F.col("__r").isNotNull() & F.col(json_col).rlike(r"^\s*\{"), F.to_json(F.expr(build(_tree(leaves)))))
    return out.withColumns({"data": data, "diagnostics": F.array_sort(F.array_distinct(notes))}).drop("__r", "__all", "__flaws")


def is_usage(harness: Column, format_: Column, data: Column) -> Column:
    """Whether a sanitized record reports usage."""
    at = lambda path: F.get_json_object(data, f"$.{path}")
    assistant = at("message.role") == "assistant"
    return F.coalesce(
        F.when(harness == "pi", (at("type") == "message") & assistant).when(harness == "claude-code", (at("type") == "assistant") & assistant)
        .when(harness == "codex", (at("type") == "event_msg") & (at("payload.type") == "token_count"))
        .when((harness == "opencode") & (format_ == "opencode-v2"), at("type") == "assistant").when(harness == "opencode", at("data.role") == "assistant"),
        F.lit(False),
    )


#: Kinds of context of each harness that has any.
CONTEXT_KINDS = {"pi": ("session",), "codex": ("session_meta", "turn_context", "task_started")}


def context_kind(harness: Column, data: Column) -> Column:
    """Name of the context that a record carries for later ones; null if none."""
    kind, inner = F.get_json_object(data, "$.type"), F.get_json_object(data, "$.payload.type")
    return F.when((harness == "pi") & (kind == "session"), "session").when((harness == "codex") & kind.isin("session_meta", "turn_context"), kind).when((harness == "codex") & (kind == "event_msg") & (inner == "task_started"), "task_started")


assert set(LEAVES) == set(HARNESSES)
