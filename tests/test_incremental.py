"""Interpretation batch by batch against all evidence at once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from usagelake.operators.interpret import scoped
from usagelake.operators.process import process
from usagelake.sources import jsonl
from usagelake.streaming.incremental import Conflict, Incremental, Store, projected

from .test_evidence import _claude, _codex, _lines, _pi

TABLES = {"facts": ["fact_id", "session_native_id", "total_tokens", "scope"], "estimates": ["fact_id", "reason_code", "evidence_id"], "outcomes": ["evidence_id", "fact_id", "disposition", "code"], "provenance": ["fact_id", "evidence_id"]}


@pytest.fixture(scope="module")
def evidence(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("forks")
    _lines(root / "pi/a.jsonl", [{"type": "session", "id": "s-pi"}, _pi("m1", 24, input=10, output=14), _pi("m2", 17, input=11, output=6), _pi("m2", 18, input=12, output=6)])
    _lines(root / "claude/projects/b.jsonl", [_claude("c1", "2026-01-02T00:00:01Z", input_tokens=10, output_tokens=5), _claude("c1", "2026-01-02T00:00:02Z", input_tokens=10, output_tokens=15)])
    _lines(root / "codex/sessions/rollout-a.jsonl", _codex("parent", ["t1", "t1"], [10, 20]))
    _lines(root / "codex/sessions/rollout-b.jsonl", _codex("child", ["t1", "t1", "t2"], [10, 20, 7], "parent"))
    _lines(root / "codex/sessions/rollout-c.jsonl", _codex("grandchild", ["t1", "t2", "t3"], [10, 20, 9], "child"))
    _lines(root / "codex/sessions/rollout-d.jsonl", _codex("orphan", ["t9"], [5], "gone"))
    found = jsonl.all_evidence(spark, {"pi": str(root / "pi"), "claude-code": str(root / "claude"), "codex": str(root / "codex")})
    return scoped(found).cache()


def _rows(df, name):
    return sorted(map(repr, (tuple(r) for r in df.select(*TABLES[name]).collect())))


def _interpret(rows):
    return projected(process(rows), rows)


def test_scopes(evidence):
    found = {(r["harness"], r["scope"], tuple(r["parents"])) for r in evidence.select("harness", "scope", "parents").collect()}
    assert found == {
        ("pi", "pi:session:s-pi", ()), ("claude-code", "claude-code:session:s-claude", ()), ("codex", "codex:session:parent", ()), ("codex", "codex:session:child", ("codex:session:parent",)),
        ("codex", "codex:session:grandchild", ("codex:session:child",)), ("codex", "codex:session:orphan", ("codex:session:gone",)),
    }
    bare = evidence.where("harness = 'pi'").withColumn("context", F.expr("filter(context, c -> false)")).where("is_usage").select("harness", "format", "source_id", "lineage", "ordinal", "data", "context", "diagnostics")
    assert all(r["scope"].startswith("pi:source:") for r in scoped(bare).collect())


def test_late_parents_change_all_tables_at_once(spark, evidence, tmp_path):
    work = Incremental(Store(spark, str(tmp_path)), _interpret)
    parts = ["scope in ('codex:session:grandchild', 'codex:session:orphan') or harness = 'claude-code'", "scope in ('codex:session:child', 'codex:session:parent') or harness = 'pi'"]
    so_far, before = "false", None
    for i, part in enumerate(parts):
        so_far = f"{so_far} or {part}"
        m = work.accept(evidence.where(part), str(i))
        whole = _interpret(evidence.where(so_far))
        for name in TABLES:
            assert _rows(work.store.read(name), name) == _rows(whole[name], name), (i, name)
        before = before or m
    codes = {r["session_native_id"]: r["reason_code"] for r in work.store.read("estimates", before).where("harness = 'codex'").collect()}
    assert codes == {"grandchild": "missing_parent", "orphan": "missing_parent"}  # the first revision still reads as it was
    now = {r["session_native_id"]: r["reason_code"] for r in work.store.read("estimates").where("harness = 'codex'").collect()}
    assert now == {"grandchild": "uncertain_replay_boundary", "orphan": "missing_parent"}  # a turn of its parent, with other counters
    assert {(r["disposition"], r["code"]) for r in work.store.read("outcomes").where("scope = 'codex:session:grandchild'").collect()} >= {("duplicate", ""), ("context", "")}
    untouched = [p for p in before["tables"]["facts"]["buckets"].items() if p in m["tables"]["facts"]["buckets"].items()]
    assert untouched  # buckets without new scopes are the same files
    newer = Incremental(work.store, _interpret, processor=2)
    replay = evidence.where(parts[0])
    assert newer.accept(replay, "0")["generation"] == 2
    for name in TABLES:
        assert _rows(work.store.read(name), name) == _rows(whole[name], name)
    with pytest.raises(Conflict):
        work.accept(replay, "9")  # an older processor


def test_labels_follow_the_batches(spark, tmp_path):
    """Groups that grow and join, against union-find over all that has come."""
    rng = random.Random(2)
    seen = []

    def counted(rows):
        seen.append(rows.count())
        return rows.groupBy("scope").agg(F.sum("n").alias("n"))

    work, known, top = Incremental(Store(spark, str(tmp_path)), counted), [], {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for i in range(5):
        batch = [(f"e{i}-{k}", f"s{rng.randrange(30):02d}", [f"s{rng.randrange(30):02d}"] if rng.random() < 0.35 else [], k) for k in range(6)]
        known += batch
        for _, s, parents, _ in batch:
            for p in [s, *parents]:
                a, b = sorted((find(s), find(p)))
                top[b] = a
        work.accept(spark.createDataFrame(batch, "evidence_id string, scope string, parents array<string>, n long"), str(i))
        assert {r["scope"]: r["component"] for r in work.store.read("labels").collect()} == {s: find(s) for s in top}
        assert sorted((r["member"], r["scope"]) for r in work.store.read("members").collect()) == sorted((s, find(s)) for s in top)
        sums = {}
        for _, s, _, n in known:
            sums[s] = sums.get(s, 0) + n
        assert {r["scope"]: r["n"] for r in work.store.read("facts").collect()} == sums
        touched = {find(s) for _, s, parents, _ in batch for s in [s, *parents]}
        assert seen[-1] == sum(find(s) in touched for _, s, _, _ in known)  # no more evidence than that of the groups
    assert json.dumps(work.store.manifest()).count("bucket=") < 64 * 16 * 7
