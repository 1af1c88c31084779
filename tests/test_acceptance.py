"""Delivered requests: decoding against hand-made flaws, acceptance against taking one request after the other."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from usagelake.streaming import acceptance
from usagelake.streaming.acceptance import Acceptor, Flaw, decode, strict
from usagelake.streaming.incremental import Incremental, Store


def _record(n, session="s", **more):
    return {"harness": "codex", "format": "jsonl", "sourceId": f"src{n}", "lineage": "0", "ordinal": 5, "data": {"type": "event_msg", "payload": {"type": "token_count"}}, "context": [{"ordinal": 1, "data": {"type": "session_meta", "payload": {"id": session}}}]} | more


def _batch(first, records, stream="st", name="b1", **more):
    return {"protocolVersion": 3, "extractorVersion": 1, "databaseId": "db", "datasetId": "default", "streamId": stream, "batchId": name, "fromSequence": first, "toSequence": first + len(records) - 1, "entries": [{"sequence": first + i, "record": r} for i, r in enumerate(records)]} | more


def _body(value):
    return json.dumps(value).encode()


def test_sound_body():
    out = decode(_body(_batch(7, [_record(1), _record(2, location={"directoryKey": "k", "directoryName": "x"}, diagnostics=["field_limit"])])))
    assert [e["sequence"] for e in out["entries"]] == [7, 8] and out["entries"][1]["directory_name"] == "x" and json.loads(out["entries"][0]["data"])["type"] == "event_msg"


@pytest.mark.parametrize(
    ("body", "reason"),
    [
        (b'{"a":1,"a":2}', "duplicate_field"), (b'{"a":{"b":1,"b":1}}', "duplicate_field"), (b"{} x", "invalid_request"), (b'{"a":NaN}', "invalid_request"), (b'"\xff"', "invalid_request"), (b"[" * 40 + b"]" * 40, "invalid_request"),
        (b"[" * 500_000, "invalid_request"), (b" " * ((1 << 20) + 1), "body_limit"), (b"{}", "incompatible"), (_body(_batch(1, [_record(1)], extra=1)), "invalid_request"), (_body(_batch(1, [_record(1)], protocolVersion=2)), "incompatible"),
        (_body(_batch(1, [])), "invalid_identity"), (_body(_batch(0, [_record(1)])), "invalid_identity"), (_body(_batch(1, [_record(1)], toSequence=9)), "invalid_identity"), (_body(_batch(1, [_record(1)], streamId="a/b")), "invalid_identity"),
        (_body(_batch(1, [_record(1)], entries=[{"sequence": 2, "record": _record(1)}])), "invalid_sequence"), (_body(_batch(1, [_record(1, ordinal=-1)])), "invalid_identity"), (_body(_batch(1, [_record(1, ordinal=1.5)])), "invalid_request"),
        (_body(_batch(1, [_record(1, data={"type": "x", "cwd": "y"})])), "private_or_unknown_field"), (_body(_batch(1, [_record(1, data={"type": "/etc"})])), "private_or_unknown_field"), (_body(_batch(1, [_record(1, diagnostics=["other"])])), "invalid_diagnostic"),
        (_body(_batch(1, [_record(1, context=[{"ordinal": 6, "data": {"type": "turn_context"}}])])), "invalid_context"), (_body(_batch(1, [_record(1, context=[{"ordinal": 1, "data": {"type": "event_msg"}}])])), "invalid_context"),
        (_body(_batch(1, [_record(1, location={"directoryName": "x"})])), "invalid_location"), (_body(_batch(1, [_record(1, location={"directoryKey": "k", "repositorySource": "z"})])), "invalid_location"), (_body(_batch(1, [_record(1, diagnostics=["field_limit"] * 9)])), "body_limit"),
    ],
)
def test_flawed_bodies(body, reason):
    with pytest.raises(Flaw, match=reason):
        decode(body)


def test_depth():
    assert strict(b"[" * 32 + b"1" + b"]" * 32) and strict(b'{"a":null}') == {"a": None}


def _one_by_one(bodies, names, sequences, evidence):
    """Codes of requests that come one after the other; what they leave stays in the dictionaries."""
    codes = []
    for body in bodies:
        try:
            b = decode(body)
        except Flaw as flaw:
            codes.append("incompatible" if str(flaw) == "incompatible" else "invalid_request")
            continue
        digest, key = hashlib.sha256(body).hexdigest(), (b["stream_id"], b["batch_id"])
        if b["dataset_id"] != "default":
            codes.append("dataset_mismatch")
            continue
        if key in names:
            codes.append("" if names[key] == digest else "batch_conflict")
            continue
        own = {(b["stream_id"], e["sequence"]): (e["source_id"], e["ordinal"], e["data"]) for e in b["entries"]}
        if any(sequences.get(k, v) != v for k, v in own.items()):
            codes.append("sequence_conflict")
            continue
        names[key] = digest
        sequences.update(own)
        evidence.update(own.values())
        codes.append("")
    return codes


def test_requests_in_order(spark, tmp_path):
    rng = random.Random(5)
    counted = lambda rows: rows.groupBy("scope").agg(F.count("*").alias("n"))
    work = Incremental(Store(spark, str(tmp_path)), counted)
    taker = Acceptor(work, "db", "default")
    names, sequences, evidence, seen, rejects = {}, {}, set(), [], 0
    for round_ in range(3):
        bodies = []
        for _ in range(9):
            first = rng.randrange(1, 9)
            made = _body(_batch(first, [_record(first + i if rng.random() < 0.85 else rng.randrange(90), session=f"s{(first + i) % 4}") for i in range(rng.randint(1, 3))], stream=rng.choice("xy"), name=f"b{rng.randrange(14)}", **({"datasetId": "other"} if rng.random() < 0.05 else {})))
            bodies.append(rng.choice(seen) if seen and rng.random() < 0.25 else b'{"a":1}x' if rng.random() < 0.08 else made)
            seen.append(bodies[-1])
        bodies.append(b'{"a":1}x')
        wanted = _one_by_one(bodies, names, sequences, evidence)
        requests = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "position long, body binary").repartition(3)
        found = {r["position"]: r for r in taker.accept(requests, 1000 + round_).collect()}
        assert [found[i]["code"] for i in range(len(bodies))] == wanted
        assert all((r["request_hash"] == hashlib.sha256(bodies[i]).hexdigest()) == (r["code"] == "") for i, r in found.items())
        assert work.store.read("evidence").count() == len(evidence) and work.store.read("sequences").count() == len(sequences) and work.store.read("receipts").count() == len(names)
        rejects += sum(c != "" for c in wanted)
        kept = work.store.read("rejects")
        assert (kept.count() if kept is not None else 0) == rejects
        assert {r["accepted_at_ms"] for r in found.values() if r["code"] == ""} <= set(range(1000, 1001 + round_))
    assert {r["code"] for r in kept.collect()} >= {"sequence_conflict", "batch_conflict", "invalid_request"}
    before = work.store.manifest()["revision"]
    again = taker.accept(spark.createDataFrame([(0, bytearray(next(b for b in seen if _one_by_one([b], dict(names), dict(sequences), set()) == [""])))], "position long, body binary"), 9).collect()
    assert again[0]["code"] == "" and again[0]["accepted_at_ms"] != 9 and work.store.manifest()["revision"] == before  # a replay gets the stored receipt
    assert acceptance.decoded(spark.createDataFrame([(1, None)], "position long, body binary")).first()["reason"] == "invalid_request"
