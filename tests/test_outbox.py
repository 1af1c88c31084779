"""From evidence to acknowledged requests."""

import json
import random

from pyspark.sql import functions as F

from usagelake.operators import outbox
from usagelake.streaming.acceptance import Acceptor, decode
from usagelake.streaming.incremental import Incremental, Store

CONTEXT = "array<struct<ordinal:bigint,data:string,diagnostics:array<string>>>"
SCHEMA = f"harness string, format string, source_id string, lineage string, ordinal long, data string, context {CONTEXT}, diagnostics array<string>, directory_key string, directory_name string, repository_key string, repository_name string, repository_source string, evidence_id string"


def _evidence(spark, ids):
    meta = [(0, '{"type":"session_meta","payload":{"id":"s"}}', [])]
    rows = [("codex", "jsonl", f"src{i % 3}", "0", i, json.dumps({"type": "event_msg", "payload": {"type": "token_count"}, "timestamp": "é" * (i % 7)}, ensure_ascii=False), meta if i % 2 else [], ["field_limit"] if i % 5 == 0 else [], "k" if i % 4 == 0 else "", "", "", "", "", f"e{i:03d}") for i in ids]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_numbers_have_no_gap(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(500)]
    found = outbox.numbered(spark.createDataFrame(rows, "a long, b long").repartition(7), ("a", "b"), 10).collect()
    assert [(r["a"], r["b"]) for r in sorted(found, key=lambda r: r["sequence"])] == sorted(rows) and sorted(r["sequence"] for r in found) == list(range(11, 511))
    assert outbox.numbered(spark.createDataFrame([], "a long"), ("a",)).count() == 0


def test_delivery(spark, tmp_path):
    store = lambda df, name: (df.write.mode("append").parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    box = store(outbox.enqueue(None, _evidence(spark, range(40))), "outbox")
    saved = store(outbox.requests(box, "st", "db", "default", most_rows=9, most_bytes=outbox.ENVELOPE + 1500), "requests")
    bodies = sorted(((r["from_sequence"], r["to_sequence"], bytes(r["body"])) for r in saved.collect()))
    assert [n for a, b, _ in bodies for n in range(a, b + 1)] == list(range(1, 41)) and len(bodies) > 5
    for a, b, body in bodies:  # each is a sound batch, within both limits, and full: the next entry wouldn't have fitted
        batch = decode(body)
        assert (batch["from_sequence"], batch["to_sequence"]) == (a, b) and b - a < 9 and len(body) <= outbox.ENVELOPE + 1500
    none = spark.createDataFrame([], "request_hash string")
    assert outbox.pending(box, saved, none).first()[0] == 40
    work = Incremental(Store(spark, str(tmp_path / "store")), lambda rows: rows.groupBy("scope").agg(F.count("*").alias("n")))
    taker = Acceptor(work, "db", "default")
    sent = outbox.open_requests(saved, none).limit(3)  # the others are lost on the way
    number = lambda df: df.withColumn("position", F.col("from_sequence")).select("position", "body")
    first = taker.accept(number(sent), 1)
    known = store(first.where("code = ''").select("request_hash"), "receipts")
    assert outbox.pending(box, saved, known).first()[0] == 40 - sum(b - a + 1 for a, b, _ in bodies[:3])
    grown = outbox.enqueue(box, _evidence(spark, range(45)))
    assert sorted(r["sequence"] for r in grown.collect()) == list(range(41, 46))  # what is there already isn't numbered again
    again = outbox.open_requests(saved, known)
    assert [(r["from_sequence"], bytes(r["body"])) for r in again.collect()] == [(a, body) for a, _, body in bodies[3:]]  # byte for byte
    second = taker.accept(number(outbox.open_requests(saved, none)), 2).collect()  # all once more: replays get their first receipt
    assert {r["code"] for r in second} == {""} and {r["accepted_at_ms"] for r in second} == {1, 2} and work.store.read("evidence").count() == 40
    known = spark.createDataFrame([(r["request_hash"],) for r in second], "request_hash string")
    assert outbox.pending(box, saved, known).first()[0] == 0 and outbox.open_requests(saved, known).count() == 0
