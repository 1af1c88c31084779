"""Requests of delivered evidence: strict decoding, what each sequence number is bound to, and receipts.

A request is a batch in JSON. Its body is decoded in tasks, and only a body without any flaw is a batch. Whether batches can be
accepted is decided in joins: a batch that was accepted before gets its receipt again, another body under its name is a
conflict, and so is a sequence number that stands for other evidence, in the store or in an earlier request. What is accepted,
the sequence numbers, receipts and rejections become visible in one revision, with all that interpretation makes of them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.facts import LOCATION
from ..operators.interpret import scoped
from ..schemas import SAFE_INTEGER
from ..sources.sanitize import CONTEXT_KINDS, LEAVES
from ..storage import kept
from .incremental import Incremental

#: Limits and versions of the protocol, and what diagnostics and sources of repositories there are.
MOST_BYTES, MOST_ENTRIES, MOST_DEPTH, MOST_CONTEXTS, MOST_DIAGNOSTICS = 1 << 20, 256, 32, 3, 8
PROTOCOL, EXTRACTOR = 3, 1
DIAGNOSTICS = ("invalid_field_type", "unsafe_metadata", "field_limit", "native_subagent_present")
REPOSITORY_SOURCES = ("harness", "git-remote", "git-common-dir", "opencode-project")
#: Names in a request, in the order of the columns that they become.
_BATCH = ("protocolVersion", "extractorVersion", "databaseId", "datasetId", "streamId", "batchId", "fromSequence", "toSequence", "entries")
_RECORD = ("harness", "format", "sourceId", "lineage", "ordinal", "data", "context", "location", "diagnostics")
_LOCATION = ("directoryKey", "directoryName", "repositoryKey", "repositoryName", "repositorySource")
#: What names and labels must not hold: the same as functions.text.UNSAFE.
_UNSAFE = re.compile(r"^/|\\|://|@|^.:/|[\x00-\x1f\x7f-\x9f]", re.DOTALL)

_CONTEXT = "array<struct<ordinal:bigint,data:string,diagnostics:array<string>>>"
_ENTRY = f"sequence:bigint,harness:string,format:string,source_id:string,lineage:string,ordinal:bigint,data:string,context:{_CONTEXT},{','.join(f'{c}:string' for c in LOCATION)},diagnostics:array<string>"
_DECODED = f"position long, request_hash string, reason string, database_id string, dataset_id string, stream_id string, batch_id string, from_sequence long, to_sequence long, entries array<struct<{_ENTRY}>>"


class Flaw(ValueError):
    """Why a body is no batch."""


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Flaw("duplicate_field")
    return out


def _no_constant(name: str) -> None:
    raise Flaw("invalid_request")


def _depth(value: object, at: int = 0) -> None:
    if at > MOST_DEPTH:
        raise Flaw("invalid_request")
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _depth(v, at + 1)


def strict(body: bytes) -> object:
    """The JSON value of a body: within the limits, in UTF-8, no key twice, nothing behind it."""
    if len(body) > MOST_BYTES:
        raise Flaw("body_limit")
    try:
        value = json.loads(body.decode(), object_pairs_hook=_object, parse_constant=_no_constant)
    except Flaw:
        raise
    except (ValueError, RecursionError):
        raise Flaw("invalid_request") from None
    _depth(value)
    return value


def _fields(value: object, names: tuple[str, ...]) -> dict:
    if not isinstance(value, dict) or set(value) - set(names):
        raise Flaw("invalid_request")
    return value


def _is(value: object, kind: type, empty: object):
    """The value if it is of the kind; null counts as absent."""
    if value is None:
        return empty
    if not isinstance(value, kind) or isinstance(value, bool):
        raise Flaw("invalid_request")
    return value


def _safe(text: str) -> bool:
    return len(text.encode(errors="replace")) <= 256 and not _UNSAFE.search(text)


def _id(text: str) -> str:
    if not text or not _safe(text) or "/" in text or " " in text:
        raise Flaw("invalid_identity")
    return text


def _leaves(value: dict, before: str = "") -> Iterator[tuple[str, object]]:
    for key, v in value.items():
        if isinstance(v, dict):
            yield from _leaves(v, f"{before}{key}.")
        else:
            yield f"{before}{key}", v


def _data(value: object, harness: str) -> str:
    """Sanitized data as text: listed leaves only, each safe."""
    if harness not in LEAVES or not isinstance(value, dict):
        raise Flaw("invalid_request")
    for path, v in _leaves(value):
        if path not in LEAVES[harness] or isinstance(v, list) or isinstance(v, str) and not _safe(v):
            raise Flaw("private_or_unknown_field")
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _diagnostics(value: object) -> list[str]:
    codes = _is(value, list, [])
    if len(codes) > MOST_DIAGNOSTICS:
        raise Flaw("body_limit")
    if any(c not in DIAGNOSTICS for c in codes):
        raise Flaw("invalid_diagnostic")
    return codes


def _ordinal(value: object, most: int = SAFE_INTEGER) -> int:
    n = _is(value, int, 0)
    if not 0 <= n <= most:
        raise Flaw("invalid_identity" if most == SAFE_INTEGER else "invalid_context")
    return n


def _kind(harness: str, data: dict) -> str | None:
    inner = data.get("payload")
    kind = "task_started" if data.get("type") == "event_msg" and isinstance(inner, dict) and inner.get("type") == "task_started" else data.get("type")
    return kind if kind in CONTEXT_KINDS.get(harness, ()) else None


def _record(value: object) -> dict:
    r = _fields(value, _RECORD)
    harness, ordinal = _is(r.get("harness"), str, ""), _ordinal(r.get("ordinal"))
    out = {"harness": harness, "format": _is(r.get("format"), str, ""), "source_id": _id(_is(r.get("sourceId"), str, "")), "lineage": _id(_is(r.get("lineage"), str, "")), "ordinal": ordinal, "data": _data(r.get("data"), harness), "diagnostics": _diagnostics(r.get("diagnostics"))}
    contexts = _is(r.get("context"), list, [])
    if len(contexts) > MOST_CONTEXTS:
        raise Flaw("body_limit")
    out["context"] = []
    for c in contexts:
        c = _fields(c, ("ordinal", "data", "diagnostics"))
        out["context"].append({"ordinal": _ordinal(c.get("ordinal"), ordinal), "data": _data(c.get("data"), harness), "diagnostics": _diagnostics(c.get("diagnostics"))})
        if not _kind(harness, c["data"]):
            raise Flaw("invalid_context")
    place = _fields(_is(r.get("location"), dict, {}), _LOCATION)
    labels = [_is(place.get(name), str, "") for name in _LOCATION]
    if place and not (labels[0] or labels[2]) or any(not _safe(x) or "/" in x for x in labels[:4]) or labels[4] and labels[4] not in REPOSITORY_SOURCES:
        raise Flaw("invalid_location")
    return out | dict(zip(LOCATION, labels, strict=True))


def decode(body: bytes) -> dict:
    """A batch's columns; Flaw if it is none."""
    b = _fields(strict(body), _BATCH)
    number = lambda name: _is(b.get(name), int, 0)
    if number("protocolVersion") != PROTOCOL or number("extractorVersion") != EXTRACTOR:
        raise Flaw("incompatible")
    out = {column: _id(_is(b.get(name), str, "")) for column, name in (("database_id", "databaseId"), ("dataset_id", "datasetId"), ("stream_id", "streamId"), ("batch_id", "batchId"))}
    first, last, entries = number("fromSequence"), number("toSequence"), _is(b.get("entries"), list, [])
    if not 0 < len(entries) <= MOST_ENTRIES or not 0 < first <= last <= SAFE_INTEGER or last - first + 1 != len(entries):
        raise Flaw("invalid_identity")
    out |= {"from_sequence": first, "to_sequence": last, "entries": []}
    for i, entry in enumerate(entries):
        entry = _fields(entry, ("sequence", "record"))
        if _is(entry.get("sequence"), int, 0) != first + i:
            raise Flaw("invalid_sequence")
        out["entries"].append({"sequence": first + i} | _record(entry.get("record")))
    return out


def decoded(requests: DataFrame) -> DataFrame:
    """requests: (position, body as binary), positions in the order of arrival. A row for each, with why it is no batch (empty: it is)."""
    names = [part.strip().split(" ")[0] for part in _DECODED.split(", entries")[0].split(",")] + ["entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for position, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = dict.fromkeys(names) | {"position": position, "request_hash": hashlib.sha256(body or b"").hexdigest(), "reason": ""}
                try:
                    row |= decode(body or b"")
                except Flaw as flaw:
                    row["reason"] = str(flaw)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=batch_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    batch_schema = to_arrow_schema(StructType.fromDDL(_DECODED))
    return requests.select("position", "body").mapInArrow(run, _DECODED)


class Acceptor:
    """Takes requests for one dataset of one database."""

    def __init__(self, work: Incremental, database_id: str, dataset_id: str):
        self.work, self.database_id, self.dataset_id = work, database_id, dataset_id

    def accept(self, requests: DataFrame, now_ms: int) -> DataFrame:
        """A response for each request: position, code (empty: accepted, now or before) and the receipt. A request is judged by what is
        stored and by the requests before it."""
        store, m = self.work.store, self.work.store.manifest()
        code = F.when(F.col("reason") == "incompatible", "incompatible").when(F.col("reason") != "", "invalid_request").when(F.col("dataset_id") != self.dataset_id, "dataset_mismatch").when(F.col("database_id") != self.database_id, "database_mismatch").otherwise("")
        rows = kept(decoded(requests).withColumn("code", code).withColumn("scope", F.sha2(F.concat_ws("\n", "stream_id", "batch_id"), 256)))
        good = rows.where("code = ''")
        claims = scoped(good.select("position", "stream_id", F.explode("entries").alias("e")).select("position", "stream_id", "e.*").withColumn("is_usage", _usage()))
        claims = kept(claims.withColumn("key", F.sha2(F.concat_ws("\n", "stream_id", F.col("sequence").cast("string")), 256)))
        known = store.lookup(m["tables"].get("receipts"), good)
        taken = store.lookup(m["tables"].get("sequences"), claims.select(F.col("key").alias("scope")))
        names = ["scope", "request_hash", "from_sequence", "to_sequence", "accepted", "accepted_at_ms", "input_revision"]
        past = good.select("position", "scope", F.col("request_hash").alias("own")).join(known.select(*names), "scope") if known is not None else None
        codes = [rows.where("code <> ''").select("position", "code")]
        left = good.select("position", "scope", "request_hash")
        if past is not None:
            codes.append(past.select("position", F.when(F.col("own") == F.col("request_hash"), "").otherwise("batch_conflict").alias("code")))
            left = left.join(past.select("position"), "position", "left_anti")
        held = taken.select(F.col("scope").alias("key"), F.col("evidence_id").alias("held")) if taken is not None else claims.limit(0).select("key", F.col("evidence_id").alias("held"))
        new, replays = self._in_order(kept(left), claims, held, codes)
        entries = kept(claims.join(new.select("position"), "position", "left_semi"))
        changed = kept(_first(entries, "evidence_id"))
        bound = _first(entries, "key").select(F.col("key").alias("scope"), "evidence_id")
        bound = kept(bound.join(taken.select("scope"), "scope", "left_anti") if taken is not None else bound)
        evidence = changed.drop("position", "stream_id", "sequence", "key")
        rejected = kept(_union(codes).where("code <> ''").join(rows.select("position", "request_hash", "reason"), "position").select(F.col("request_hash").alias("scope"), "code", "reason"))
        fresh = new.join(rows.select("position", "from_sequence", "to_sequence", F.size("entries").cast("long").alias("accepted")), "position").select("scope", "request_hash", "from_sequence", "to_sequence", "accepted", F.lit(now_ms).cast("long").alias("accepted_at_ms"))
        if not (new.isEmpty() and rejected.isEmpty()):

            def also(before: dict, tables: dict) -> dict:
                same = tables.get("evidence") == before["tables"].get("evidence")
                revision = before.get("input_revision", 0) if same else before["revision"] + 1
                out = {}
                if not rejected.isEmpty():
                    out["rejects"] = store.append(tables.get("rejects"), rejected, "rejects")
                if not new.isEmpty():
                    out["receipts"] = store.append(tables.get("receipts"), fresh.withColumn("input_revision", F.lit(revision).cast("long")), "receipts")
                    out["sequences"] = store.append(tables.get("sequences"), bound, "sequences")
                return out

            run = hashlib.sha256("\n".join(sorted(r["request_hash"] for r in new.unionByName(replays).select("request_hash").distinct().collect())).encode()).hexdigest()
            m = self.work.accept(evidence, f"requests-{m['revision']}-{run}", also, known="ignore")
        stored = store.lookup(m["tables"].get("receipts"), good)
        answers = rows.select("position", "scope", "stream_id", "batch_id").join(_union(codes).unionByName(new.unionByName(replays).select("position", F.lit("").alias("code"))), "position")
        if stored is None:
            return answers.drop("scope")
        ok = answers.withColumn("scope", F.when(F.col("code") == "", F.col("scope")))
        return ok.join(stored.select(*names), "scope", "left").drop("scope")

    @staticmethod
    def _in_order(left: DataFrame, claims: DataFrame, held: DataFrame, codes: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(accepted, replays of these) among requests whose names aren't stored; what is rejected goes to codes. Each round looks at the
        first undecided request of each name: it is rejected if it claims a sequence number that is held for other evidence, and
        accepted if no earlier undecided request claims one of its own for other evidence. The earliest of all is always decided."""
        new, replays = left.limit(0), left.limit(0)
        own = claims.select("position", "key", "evidence_id").distinct()
        while not left.isEmpty():
            named = Window.partitionBy("scope").orderBy("position")
            first = left.withColumn("__n", F.row_number().over(named)).where("__n = 1").drop("__n")
            bad = kept(own.join(first.select("position"), "position", "left_semi").join(held, "key").where("held <> evidence_id").select("position").distinct())
            codes.append(bad.withColumn("code", F.lit("sequence_conflict")))
            left = kept(left.join(bad, "position", "left_anti"))
            before = Window.partitionBy("key").orderBy("position").rangeBetween(Window.unboundedPreceding, -1)
            at = own.join(left.select("position"), "position", "left_semi").withColumns({"__min": F.min("evidence_id").over(before), "__max": F.max("evidence_id").over(before)})
            odd = at.where("__min <> evidence_id or __max <> evidence_id").select("position").distinct()
            clear = kept(first.join(bad, "position", "left_anti").join(odd, "position", "left_anti"))
            rest = left.join(clear.select("position"), "position", "left_anti")
            again = kept(rest.join(clear.select("scope", F.col("request_hash").alias("__hash")), "scope"))
            codes.append(again.where("request_hash <> __hash").select("position", F.lit("batch_conflict").alias("code")))
            new, replays = new.unionByName(clear), replays.unionByName(again.where("request_hash = __hash").select(*left.columns))
            held = kept(held.unionByName(own.join(clear.select("position"), "position", "left_semi").select("key", F.col("evidence_id").alias("held"))).distinct())
            left = kept(rest.join(again.select("position"), "position", "left_anti"))
        return kept(new), kept(replays)


def _usage():
    from ..sources.sanitize import is_usage

    return is_usage(F.col("harness"), F.col("format"), F.col("data"))


def _first(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, that of the earliest request."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("position", "sequence"))).where("__n = 1").drop("__n")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
