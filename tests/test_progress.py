"""Attempts with leases: answers against a plain history, streams over restarts and timers, snapshots against the state."""

import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from usagelake.streaming import progress
from usagelake.streaming.progress import MESSAGE, MOST_ATTEMPTS, Attempts, follow, messages_of_json, snapshot, valid, visible

_SET = {"instance_id": "i", "received_at_ms": 1000, "position": 0, "operation": "begin", "attempt_id": "0" * 32, "stage": "", "harnesses": {}, "acknowledged_batches": 0, "acknowledged_entries": 0, "pending": None, "error_code": ""}


def _m(**more):
    return _SET | more


def _id(n):
    return f"{n:032x}"


def _rows(spark, messages):
    return spark.createDataFrame([Row(**m) for m in messages], MESSAGE)


def test_which_messages_are_valid(spark):
    good = [
        _m(), _m(stage="waiting", pending=3), _m(attempt_id="01234567-89ab-cdef-0123-456789abcdef"), _m(operation="heartbeat"), _m(operation="update", stage="capturing", harnesses={"codex": "running"}, acknowledged_batches=2**53 - 1),
        _m(operation="finish", stage="accepted"), _m(operation="finish", stage="failed", error_code="cancelled"), _m(operation="interrupt_all", attempt_id=""),
    ]
    bad = [
        _m(attempt_id="0" * 31), _m(attempt_id="0" * 32 + "\n"), _m(attempt_id="A" * 32), _m(stage="capturing"), _m(acknowledged_batches=1), _m(error_code="cancelled"), _m(operation="heartbeat", stage="waiting"), _m(operation="heartbeat", pending=0),
        _m(operation="update", stage=""), _m(operation="update", stage="accepted"), _m(operation="update", stage="waiting", acknowledged_entries=-1), _m(operation="update", stage="waiting", acknowledged_entries=2**53), _m(operation="update", stage="waiting", pending=-1),
        _m(operation="update", stage="waiting", harnesses={"other": "running"}), _m(operation="update", stage="waiting", harnesses={"codex": "gone"}), _m(operation="update", stage="waiting", harnesses={"codex": None}), _m(operation="finish", stage="accepted", error_code="cancelled"),
        _m(operation="finish", stage="failed"), _m(operation="finish", stage="failed", error_code="other"), _m(operation="stop"), _m(operation=""), _m(operation="interrupt_all"),
    ]
    got = [r.fine for r in _rows(spark, [_m(**{**m, "position": i}) for i, m in enumerate(good + bad)]).withColumn("fine", valid()).orderBy("position").collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_bodies(spark):
    bodies = ['{"operation":"begin","attemptId":"a","pendingKnown":true}', '{"operation":"begin","attemptId":"a","pending":4}', "no json", '{"operation":"update","harnesses":{"pi":"running"},"acknowledgedBatches":2}', None]
    df = spark.createDataFrame([("i", 1, i, b) for i, b in enumerate(bodies)], "instance_id string, received_at_ms long, position long, body string")
    got = messages_of_json(df).orderBy("position").collect()
    assert [(r.operation, r.pending, r.harnesses, r.acknowledged_batches) for r in got] == [("begin", 0, None, None), ("begin", -1, None, None), (None, None, None, None), ("update", None, {"pi": "running"}, 2), (None, None, None, None)]


class _Plain:
    """Answers by looking at everything that was accepted before, with nothing kept but that history."""

    def __init__(self):
        self.lives = []  # [id, start, [(at, message)], end or None, stage, dropped]

    def _settle(self, now):
        for life in self.lives:
            last = life["seen"][-1]
            if life["end"] is None and now - last >= 15_000:
                life["end"], life["stage"] = last + 15_000, "interrupted"
            if life["end"] is not None and now - life["end"] >= 300_000:
                life["dropped"] = True

    def _known(self):
        return [x for x in self.lives if not x["dropped"]]

    def take(self, m):
        if not m["fine"]:
            return "invalid"
        now = m["received_at_ms"]
        self._settle(now)
        if m["operation"] == "interrupt_all":
            for x in self._known():
                if x["end"] is None:
                    x["end"], x["stage"] = now, "interrupted"
            return "accepted"
        mine = [x for x in self._known() if x["id"] == m["attempt_id"]]
        if m["operation"] == "begin":
            if mine:
                return "conflict"
            if len(self._known()) >= 32:
                over = sorted((x for x in self._known() if x["end"] is not None), key=lambda x: (x["end"], x["id"]))
                if not over:
                    return "busy"
                over[0]["dropped"] = True
            self.lives.append({"id": m["attempt_id"], "seen": [now], "end": None, "stage": "waiting", "dropped": False, "acked": (0, 0)})
            return "accepted"
        if not mine:
            return "missing"
        x, acked = mine[0], (m["acknowledged_batches"], m["acknowledged_entries"])
        if x["end"] is not None or (m["operation"] != "heartbeat" and (acked[0] < x["acked"][0] or acked[1] < x["acked"][1])):
            return "conflict"
        x["seen"].append(now)
        if m["operation"] != "heartbeat":
            x["acked"], x["stage"] = acked, m["stage"]
        if m["operation"] == "finish":
            x["end"] = now
        return "accepted"

    def state(self, now):
        self._settle(now)
        return {x["id"]: (x["stage"], x["end"] or 0) for x in self._known()}


def _random(rng, n, names, step):
    at, out = 1_000_000, []
    for i in range(n):
        at += rng.choice(step)
        kind = rng.choices(["begin", "heartbeat", "update", "finish", "interrupt_all", "bad"], [6, 3, 6, 3, 0.1, 0.3])[0]
        m = _m(received_at_ms=at, position=i, attempt_id=_id(rng.randrange(names)), operation=kind)
        if kind == "update":
            m |= {"stage": rng.choice(["waiting", "capturing", "submitting"]), "acknowledged_batches": rng.randrange(4), "acknowledged_entries": rng.randrange(4), "pending": rng.choice([None, 5]), "harnesses": {"pi": "running"}}
        if kind == "finish":
            m |= {"stage": "accepted", "acknowledged_batches": 9, "acknowledged_entries": 9} if rng.random() < 0.5 else {"stage": "failed", "error_code": "cancelled", "acknowledged_batches": 9, "acknowledged_entries": 9}
        if kind == "interrupt_all":
            m["attempt_id"] = ""
        out.append(m)
    return out


@pytest.mark.parametrize(("names", "step"), [(5, (1, 500, 6_000)), (80, (1, 50)), (60, (1, 200, 2_000)), (3, (20_000, 100_000, 1))])
def test_answers_against_a_plain_history(names, step):
    for seed in range(5):
        messages = _random(random.Random(seed), 800, names, step)
        plain, held, seen = _Plain(), Attempts("i", {}), set()
        for m in messages:
            m = m | {"fine": m["operation"] != "bad", "harnesses": "{}"}
            answer = plain.take(m)
            assert held.take(m) == answer
            seen.add(answer)
            held.pass_time(m["received_at_ms"])
            assert {n: (a["stage"], a["finished_at_ms"]) for n, a in held.held.items()} == plain.state(m["received_at_ms"]) and len(held.held) <= MOST_ATTEMPTS
        assert {"accepted", "conflict"} <= seen and (names != 80 or "busy" in seen)


def test_table_and_snapshots(spark):
    rng = random.Random(3)
    messages = [m | {"instance_id": f"i{k}"} for k in range(4) for m in _random(rng, 300, 12, (1, 300, 4_000))]
    rng.shuffle(messages)
    log = follow(_rows(spark, messages).withColumn("answer", F.lit("clash"))).cache()
    answers = {(r.instance_id, r.position): r.answer for r in log.where("answer <> ''").collect()}
    for now in (1_100_000, 1_300_000, 10_000_000):
        got = {}
        for r in snapshot(log, now).collect():
            got.setdefault(r.instance_id, {})[r.attempt_id] = (r.stage, r.finished_at_ms)
        for k in range(4):
            plain = _Plain()
            for m in sorted((m for m in messages if m["instance_id"] == f"i{k}"), key=lambda m: (m["received_at_ms"], m["position"])):
                if m["received_at_ms"] <= now:
                    answer = plain.take(m | {"fine": m["operation"] != "bad"})
                    # The end of a service is told by the attempts that it ends.
                    assert m["operation"] == "interrupt_all" or answers[(f"i{k}", m["position"])] == answer
            assert got.get(f"i{k}", {}) == plain.state(now)
    shown = visible(snapshot(log, 1_300_000)).collect()
    ended = [r.instance_id for r in shown if r.stage in progress.ENDED]
    assert len(ended) == len(set(ended)) and {r.label for r in shown} <= set(progress.STAGES.values())
    log.unpersist()


def test_empty_and_odd_tables(spark):
    assert follow(_rows(spark, [])).collect() == [] and visible(snapshot(follow(_rows(spark, [])), 5)).collect() == []
    nulls = [dict.fromkeys(_SET) | {"instance_id": "i", "received_at_ms": 5}, dict.fromkeys(_SET) | {"received_at_ms": 5}, dict.fromkeys(_SET) | {"instance_id": "i"}, _m(), _m()]
    assert sorted(r.answer for r in follow(_rows(spark, nulls)).collect()) == ["accepted", "conflict", "invalid"]


def test_stream_with_timers_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    _rows(spark, []).write.parquet(source)

    def start():
        log = follow(spark.readStream.schema(MESSAGE).parquet(source))
        return log.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(processingTime="500 milliseconds").start()

    def wait(query, holds):
        end = time.time() + 60
        rows = []
        while time.time() < end:
            assert query.exception() is None
            try:
                rows = spark.read.parquet(sink).collect()
            except Exception:
                rows = []
            if holds(rows):
                return rows
            time.sleep(0.4)
        raise AssertionError(rows)

    try:
        now = int(time.time() * 1000)
        # The first one's lease ends in some seconds, the second has ended almost five minutes ago, the third keeps its lease.
        old = now - 292_000
        first = [_m(attempt_id=_id(2), received_at_ms=old), _m(attempt_id=_id(2), operation="finish", stage="accepted", received_at_ms=old, position=1), _m(attempt_id=_id(1), received_at_ms=now - 7_000), _m(attempt_id=_id(3), received_at_ms=now + 60_000)]
        query = start()
        _rows(spark, first).coalesce(1).write.mode("append").parquet(source)
        wait(query, lambda rows: len(rows) >= 4)
        query.stop()
        query = start()
        rows = wait(query, lambda rows: {r.cause for r in rows} >= {"expired", "forgotten"})
        timed = {r.cause: r for r in rows if r.answer == ""}
        assert timed["expired"].attempt_id == _id(1) and timed["expired"].at_ms == now + 8_000 and timed["expired"].error_code == "publisher_lost"
        assert timed["forgotten"].attempt_id == _id(2) and timed["forgotten"].at_ms == old + 300_000
        # Messages of after the restart meet the state of before it.
        later = [_m(attempt_id=_id(n), operation="heartbeat", received_at_ms=now + 61_000, position=10 + n) for n in (1, 2, 3)]
        _rows(spark, later).coalesce(1).write.mode("append").parquet(source)
        rows = wait(query, lambda rows: sum(r.position > 10 for r in rows) == 3)
        assert [r.answer for r in sorted(rows, key=lambda r: r.position)][-3:] == ["conflict", "missing", "accepted"]
        query.stop()
        assert {r.attempt_id: r.stage for r in snapshot(spark.read.parquet(sink), now + 62_000).collect()} == {_id(1): "interrupted", _id(3): "waiting"}
    finally:
        for q in spark.streams.active:
            q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
