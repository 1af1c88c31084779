"""Fixed schemas. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SAFE_INTEGER = (1 << 53) - 1
LAST_MS = 253402214399999
HARNESSES = ("opencode", "pi", "codex", "claude-code")
TOKENS = ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")


def _struct(text: str, nullable: bool = False) -> T.StructType:
    kinds = {"S": T.StringType(), "L": T.LongType(), "B": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind], nullable) for name, kind in (x.split(":") for x in text.split())])


FACT = _struct(
    "dataset_id:S fact_id:S scope:S harness:S session_id:S session_native_id:S message_native_id:S native_request_id:S occurred_at_ms:L "
    "provider:S provider_source:S model:S usage_scope:S quality:S countable:B input_tokens:L output_tokens:L reasoning_tokens:L cache_read_tokens:L "
    "cache_write_tokens:L total_tokens:L directory_key:S directory_name:S repository_key:S repository_name:S repository_source:S payload_json:S generation:L input_revision:L"
)
ESTIMATE = T.StructType([*FACT.fields, *_struct("evidence_id:S reason_code:S").fields])
#: A native record after sanitizing: data and contexts are JSON text.
EVIDENCE = T.StructType(
    [
        *_struct("harness:S format:S source_id:S lineage:S ordinal:L data:S").fields,
        T.StructField("context", T.ArrayType(T.StructType([*_struct("ordinal:L data:S").fields, T.StructField("diagnostics", T.ArrayType(T.StringType()))]))),
        *_struct("directory_key:S directory_name:S repository_key:S repository_name:S repository_source:S", True).fields,
        T.StructField("diagnostics", T.ArrayType(T.StringType())),
    ]
)


def same_layout(found: T.StructType, wanted: T.StructType) -> list[str]:
    """What differs between a table and the schema it must have: names, order and types. Nullability is not stored."""
    pairs = [(f.name, f.dataType.simpleString()) for f in found.fields], [(f.name, f.dataType.simpleString()) for f in wanted.fields]
    return [f"{a or 'nothing'} instead of {b or 'nothing'}" for a, b in zip(pairs[0] + [None] * len(pairs[1]), pairs[1] + [None] * len(pairs[0]), strict=False) if a != b and (a or b)]
