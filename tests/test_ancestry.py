"""Forked sessions against a walk over one session at a time."""

import random

import pytest
from pyspark.sql import functions as F

from usagelake.operators import ancestry, context

ROW = "session string, evidence_id string, fact_id string, ordinal long, occurred_at_ms long, turn string, fingerprint string, counters struct<sum:long,input:long,cache:long,output:long,reasoning:long,total:long>, code string"
META = "session string, parent string, is_fork boolean, conflict boolean"


def _walk(rows, metas):
    """{evidence_id: (fact_id, session, code)}: each session after its parent."""
    meta = {m[0]: m for m in metas}
    by_session = {}
    for r in sorted(rows, key=lambda r: (r[4], r[3], r[1])):
        by_session.setdefault(r[0], []).append(r)
    problems, proofs, open_, out = {}, {}, set(), {}

    def settle(s):
        if s in proofs and s not in open_:
            return
        if s in open_:
            problems[s] = "ancestry_cycle"
            return
        open_.add(s)
        proofs[s] = []
        _, parent, fork, conflict = meta.get(s, (s, "", False, False))
        problem = "missing_session_context" if s not in meta else "conflicting_parent" if conflict else ""
        above = []
        if fork and parent not in meta:
            problem = "missing_parent"
        elif fork:
            settle(parent)
            if problems.get(parent) or parent in open_:
                problem = "unresolved_parent"
            else:
                above = proofs[parent]
        problem = problems.get(s) or problem
        seen, mark, last, mine = {}, None, None, list(above)
        for _, eid, fact, _, _, turn, fp, counters, code in by_session.get(s, []):
            same = {(f, o) for p, f, o, _ in above if fp and p == fp}
            if len(same) == 1:
                out[eid] = (*same.pop(), "known_duplicate")
                continue
            if fact in seen:
                out[eid] = (fact, s, seen[fact] or code)
                continue
            if fork and last is not None and turn != last:
                mark = None
            last = turn
            if counters and mark and counters == mark:
                code = "known_duplicate"
            elif counters and mark and counters[0] < mark[0]:
                code = "stale_snapshot"
            else:
                mark = counters or mark
                if problem:
                    code = problem
                elif not fp:
                    code = code or "unverifiable_snapshot"
                elif len(same) > 1:
                    code = "ambiguous_parent_fact"
                elif any(t == turn or t.startswith(f"{turn}:") for _, _, _, t in above):
                    code = "uncertain_replay_boundary"
                if not code:
                    mine.append((fp, fact, s, turn))
            seen[fact] = code
            out[eid] = (fact, s, code)
        problems[s], proofs[s] = problem, mine
        open_.discard(s)

    for s in sorted(by_session):
        settle(s)
    return out


def _forest(seed):
    rng = random.Random(seed)
    names = [f"s{i:02d}" for i in rng.sample(range(60), 40)]
    metas, rows = [], []
    for i, s in enumerate(names):
        kind = rng.random()
        parent = "" if kind < 0.25 else rng.choice(names[:i] or [s]) if kind < 0.8 else rng.choice([*names, "gone"])
        if rng.random() < 0.95:
            metas.append((s, parent, bool(parent) or rng.random() < 0.05, rng.random() < 0.06))
        for n in range(rng.randint(0, 14)):
            turn, shot = rng.choice(["a", "a:b", "b", "c", ""]), rng.randint(0, 5)
            sound = turn and rng.random() < 0.85
            counters = None if rng.random() < 0.1 else (c := rng.randint(1, 4), c, 0, rng.randint(0, 1), 0, -1)
            fact = f"{s}-{rng.randint(0, 11)}"
            rows.append((s, f"e-{s}-{n}", fact, n, rng.randint(0, 20), turn, f"{turn}/{shot}" if sound else "", counters, "" if sound or rng.random() < 0.7 else "invalid_source_counters"))
    return rows, metas


@pytest.mark.parametrize("seed", range(3))
def test_forests(spark, seed):
    rows, metas = _forest(seed)
    found = ancestry.decide(spark.createDataFrame(rows, ROW), spark.createDataFrame(metas, META)).collect()
    assert {r["evidence_id"]: (r["fact_id"], r["session_native_id"], r["code"]) for r in found} == _walk(rows, metas) and len(found) == len(rows)
    assert seed or {r["code"] for r in found} >= {"known_duplicate", "stale_snapshot", "unresolved_parent", "missing_parent", "uncertain_replay_boundary"}


def test_circles_and_empty(spark):
    """A circle is entered from the smallest session that leads to it, here one that hangs below its middle."""
    metas = [("b", "c", True, False), ("c", "d", True, False), ("d", "b", True, False), ("a", "c", True, False), ("z", "z", True, False)]
    rows = [(s, f"e-{s}", f"f-{s}", 0, 0, "t", "p", None, "") for s in "abcdz"]
    found = {r["session_native_id"]: r["code"] for r in ancestry.decide(spark.createDataFrame(rows, ROW), spark.createDataFrame(metas, META)).collect()}
    assert found == {"a": "unresolved_parent", "b": "unresolved_parent", "c": "ancestry_cycle", "d": "unresolved_parent", "z": "ancestry_cycle"}
    assert ancestry.decide(spark.createDataFrame([], ROW), spark.createDataFrame([], META)).count() == 0


def test_next_value_looks_ahead(spark):
    rng = random.Random(1)
    rows = [(f"s{i % 3}", "0", i, rng.random() < 0.2, None if rng.random() < 0.3 else f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "source_id string, lineage string, ordinal long, hit boolean, v string")
    found = {r["ordinal"]: r["later"] for r in context.next_value(df, F.col("hit"), F.col("v"), "later").collect()}
    assert found == {i: next((v for s, _, j, hit, v in rows[i + 1 :] if s == f"s{i % 3}" and hit and v is not None), None) for i in range(200)}
