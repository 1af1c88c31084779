"""Native records to facts: small files of each harness."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from usagelake.operators.process import process
from usagelake.sources import jsonl, sqlite
from usagelake.streaming.incremental import Conflict, Incremental, Store


def _pi(id_, total, **usage):
    return {"type": "message", "id": id_, "timestamp": "2026-01-02T00:00:00Z", "message": {"role": "assistant", "provider": "openai-codex", "model": "m", "timestamp": 1767312000000, "usage": usage | {"totalTokens": total}}}


def _claude(id_, time, session="s-claude", **usage):
    return {"type": "assistant", "timestamp": time, "uuid": f"u-{id_}-{time}", "sessionId": session, "requestId": "r1", "message": {"id": id_, "role": "assistant", "model": "c", "usage": usage}}


def _codex(session, turn, n, parent=None):
    count = lambda k: {"input_tokens": k, "cached_input_tokens": 0, "output_tokens": k, "reasoning_output_tokens": 0, "total_tokens": 2 * k}
    meta = {"type": "session_meta", "payload": {"id": session, "model_provider": "openai", "cwd": "/srv/x", "git": {"repository_url": "git@Host:a/b.git"}} | ({"forked_from_id": parent} if parent else {})}
    out = [meta]
    at = 0
    for t, k in zip(turn, n, strict=True):
        at += k
        out += [{"type": "turn_context", "payload": {"turn_id": t, "model": "g"}}, {"timestamp": f"2026-01-02T00:00:{at:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": count(k), "total_token_usage": count(at)}}}]
    return out


def _lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture(scope="module")
def evidence(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("native")
    _lines(root / "pi/project/a.jsonl", [{"type": "session", "id": "s-pi", "version": 1, "cwd": "/home/me/work//pi"}, _pi("m1", 24, input=10, output=7, reasoning=2, cacheRead=3, cacheWrite=4), _pi("m1", 24, input=10, output=7, reasoning=2, cacheRead=3, cacheWrite=4), _pi("m2", 17, input=11, output=6), _pi("m2", 18, input=12, output=6), {"type": "message", "message": {"role": "user"}}])
    _lines(root / "claude/projects/p/b.jsonl", [_claude("c1", "2026-01-02T00:00:01Z", input_tokens=10, output_tokens=5), _claude("c1", "2026-01-02T00:00:02Z", input_tokens=10, output_tokens=15)])
    _lines(root / "codex/sessions/2026/rollout-a.jsonl", _codex("parent", ["t1", "t1"], [10, 20]))
    _lines(root / "codex/sessions/2026/rollout-b.jsonl", _codex("child", ["t1", "t1", "t2"], [10, 20, 7], "parent"))
    _lines(root / "codex/sessions/2026/rollout-c.jsonl", _codex("orphan", ["t9"], [5], "gone"))
    (root / "open").mkdir()
    db = sqlite3.connect(root / "open/opencode.db")
    db.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INT, time_updated INT, data TEXT)")
    db.execute("CREATE TABLE session_message (id TEXT, session_id TEXT, type TEXT, time_created INT, time_updated INT, data TEXT)")
    tokens = lambda k: {"input": 100 + k, "output": 50 + k, "reasoning": 10 + k, "cache": {"read": 20 + k, "write": 5 + k}}
    db.execute("INSERT INTO message VALUES ('o1', 's-open', 1767312000000, 1, ?)", [json.dumps({"role": "assistant", "providerID": "p", "modelID": "m", "tokens": tokens(0)})])
    db.execute("INSERT INTO session_message VALUES ('o1', 's-open', 'assistant', 1767312000000, 1, ?)", [json.dumps({"model": {"providerID": "p", "id": "m"}, "tokens": tokens(1)})])
    db.execute("CREATE TABLE session (id TEXT, directory TEXT, project_id TEXT)")
    db.execute("CREATE TABLE project (id TEXT, vcs TEXT)")
    db.execute("INSERT INTO session VALUES ('s-open', '/home/me/open', 'p1')")
    db.execute("INSERT INTO project VALUES ('p1', 'git')")
    db.execute("PRAGMA journal_mode = WAL")
    db.commit()
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    db.close()
    files = jsonl.all_evidence(spark, {"pi": str(root / "pi"), "claude-code": str(root / "claude"), "codex": str(root / "codex")})
    return files.unionByName(sqlite.evidence(spark, str(root / "open"))).cache()


def test_facts(evidence):
    found = {(r["harness"], r["session_native_id"], r["total_tokens"]) for r in process(evidence).facts.collect()}
    assert found == {
        ("pi", "s-pi", 24),  # a repeated record counts once
        ("claude-code", "s-claude", 25),  # the later revision of a request
        ("codex", "parent", 20), ("codex", "parent", 40),  # the child's first two rows are copies of these
        ("codex", "child", 14), ("opencode", "s-open", 190),  # the second format wins
    }


def test_locations(evidence):
    found = {(r["harness"], r["directory_name"], r["repository_name"], r["repository_source"]) for r in process(evidence).facts.collect()}
    assert found == {("pi", "pi", "", ""), ("claude-code", "", "", ""), ("codex", "x", "b", "harness"), ("opencode", "open", "open", "opencode-project")}


def test_estimates_and_outcomes(evidence):
    p = process(evidence)
    assert {(r["harness"], r["reason_code"]) for r in p.estimates.collect()} == {("pi", "conflicting_native_identity"), ("codex", "missing_parent")}
    counts = {(r["disposition"], r["code"]): r["count"] for r in p.outcomes.groupBy("disposition", "code").count().collect()}
    assert counts[("ambiguous", "missing_parent")] == 1 and counts[("ambiguous", "conflicting_native_identity")] == 2


def test_nothing_but_listed_leaves(spark):
    from usagelake.sources.sanitize import sanitize

    rows = [('{"type":"message","id":"a/../b","secret":"x","message":{"role":{"deep":1},"model":"/etc"}}',), ("not json",), ("[1]",)]
    found = sanitize(spark.createDataFrame(rows, "value string"), "pi").collect()
    assert json.loads(found[0]["data"]) == {"type": "message", "id": "a/../b", "message": {"usage": {}}}
    assert found[0]["diagnostics"] == ["invalid_field_type", "unsafe_metadata"] and found[2]["data"] is None


def test_incremental_equals_whole(spark, tmp_path):
    rows = [(f"e{i}", f"s{i % 3}", [f"s{(i + 1) % 3}"] if i == 7 else [], i) for i in range(12)]
    frame = lambda part: spark.createDataFrame(part, "evidence_id string, scope string, parents array<string>, n long")
    sums = lambda e: e.groupBy("scope").agg(F.sum("n").alias("n"))
    work = Incremental(Store(spark, str(tmp_path)), sums)
    work.accept(frame(rows[:5]), "1")
    first = work.store.manifest()
    work.accept(frame(rows[5:]), "2")
    work.accept(frame(rows[5:]), "2")
    with pytest.raises(Conflict):
        work.accept(frame(rows[:2]), "2")
    with pytest.raises(Conflict):
        work.accept(frame([("e1", "s1", [], 100)]), "3")  # an id with other content
    with pytest.raises(Conflict):
        work.store.publish(work.store.manifest())  # a revision that is there
    wanted = sorted(map(tuple, sums(frame(rows)).collect()))
    assert sorted(map(tuple, work.store.read("facts").select("scope", "n").collect())) == wanted
    assert work.store.read("facts", first).count() == 3  # an earlier manifest still reads its own state
    work.reprocess()
    assert sorted(map(tuple, work.store.read("facts").select("scope", "n").collect())) == wanted and work.store.manifest()["generation"] == 2


def test_stream_is_the_same(spark, tmp_path):
    frame = spark.range(20).selectExpr("concat('e', id) AS evidence_id", "concat('s', id % 4) AS scope", "id AS n")
    for i in range(2):
        frame.where(f"n % 2 = {i}").write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    work = Incremental(Store(spark, str(tmp_path / "store")), lambda e: e.groupBy("scope").agg(F.sum("n").alias("n")))
    work.run(stream, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(map(tuple, work.store.read("facts").select("scope", "n").collect())) == [(f"s{i}", 40 + 5 * i) for i in range(4)]
