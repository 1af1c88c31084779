"""Growing files scan by scan, and long lines against a whole parser."""

import json
import random

import pytest

from usagelake.sources import jsonl, tail
from usagelake.sources.longlines import LineJudge


def _judge(text, size=7):
    judge = LineJudge()
    for i in range(0, len(text), size):
        judge.feed(text[i : i + size])
    return judge


def _object(text):
    try:
        return isinstance(json.loads(text, parse_constant=tail._no_constant), dict)
    except ValueError:
        return False


def test_grammar_is_jsons():
    rng = random.Random(3)

    def value(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.5:
            return rng.choice(['"a\\u00e9\\n\\\\"', '"\\/ plain"', "0", "-0.5e+3", "12", "1E9", "true", "false", "null", '""', '"é"'])
        space = rng.choice(["", " ", "\t", "\r\n"])
        if kind < 0.75:
            return "[" + f",{space}".join(value(depth + 1) for _ in range(rng.randint(0, 3))) + "]"
        return "{" + space + ",".join(f'{space}"{rng.choice(["type", "payload", "x", "message"])}"{space}:{space}{value(depth + 1)}' for _ in range(rng.randint(0, 3))) + "}"

    seen = set()
    for _ in range(6000):
        text = value(0) if rng.random() < 0.2 else "{" + f'"k":{value(0)}' + "}"
        if rng.random() < 0.6:  # break it somewhere
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", '"', "\\", "{", "]", ",", ":", "0", "-", ".", "e", "\x01", "t", " ", "u"]) + text[i + rng.randint(0, 1) :]
        raw = text.encode()
        for size in (1, 7, 10_000):
            assert _judge(raw, size).sound() == _object(text), text
        seen.add(_object(text))
    assert seen == {True, False}
    assert not _judge(b'{"a":' + b"[" * 10_000).sound() and _judge(b'{"a":' + b"[" * 9_999 + b"]" * 9_999 + b"}", 4096).sound()


@pytest.mark.parametrize(
    ("line", "harness", "wanted"),
    [
        ('{"type":"response_item","x":"LONG"}', "codex", True), ('{"x":"LONG","type":"event_msg","payload":{"type":"user_message","n":[1]}}', "codex", True), ('{"type":"event_msg","payload":{"type":"token_count","x":"LONG"}}', "codex", False),
        ('{"type":"response_item","x":"LONG","type":"response_item"}', "codex", False), ('{"x":{"type":"response_item"},"y":"LONG"}', "codex", False), ('{"type":"message","message":{"role":"user","c":"LONG"}}', "pi", True),
        ('{"type":"message","message":{"role":"assistant","c":"LONG"}}', "pi", False), ('{"type":"us\\u0065r","c":"LONG"}', "claude-code", True), ('{"type":"user","c":"LONG"', "claude-code", False), ('["type","user"]', "claude-code", False),
        ('{"payload":{"type":"user_message"},"type":"event_msg","payload":{}}', "codex", False), ('{"type":"LONG"}', "codex", False), ('{"message":"LONG","type":"label"}', "pi", True), ('{"message":[{"role":"user"}],"type":"message"}', "pi", False),
    ],
)
def test_what_is_irrelevant(line, harness, wanted):
    text = line.replace("LONG", "é\\n" * 4000).encode()
    assert _judge(text, 1000).irrelevant(harness) == wanted
    judge = _judge(text, 1000)
    assert len(judge._rest) < 8 and len(judge._text) < 1200


def _use(n):
    return {"timestamp": f"2026-01-02T00:00:{n:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n}}}}


META = {"type": "session_meta", "payload": {"id": "s", "cwd": "/srv/one", "model_provider": "p"}}
TURN = {"type": "turn_context", "payload": {"turn_id": "t", "model": "m"}}


class _Scans:
    """Each scan takes the tables that the one before has written, as after a restart."""

    def __init__(self, spark, root, folder, most=jsonl.MOST_LINE_BYTES):
        self.spark, self.root, self.folder, self.most, self.n = spark, str(root), str(folder), most, 0

    def __call__(self):
        tables = [self.spark.read.parquet(f"{self.folder}/{t}-{self.n}") if self.n else None for t in ("cursors", "failures")]
        found = tail.scan(self.spark, "codex", self.root, *tables, most=self.most)
        self.n += 1
        rows = found.evidence.collect()
        found.cursors.write.parquet(f"{self.folder}/cursors-{self.n}")
        found.failures.write.parquet(f"{self.folder}/failures-{self.n}")
        self.cursors, self.failures = found.cursors.collect(), found.failures.collect()
        usage = sorted((r for r in rows if r["is_usage"]), key=lambda r: (r["source_id"], r["ordinal"]))
        return [(r["ordinal"], json.loads(r["data"])["payload"]["info"]["last_token_usage"]["input_tokens"], [json.loads(c["data"])["type"] for c in r["context"]], r["directory_name"], r["lineage"]) for r in usage]


def _text(*rows, end="\n"):
    return "\n".join(json.dumps(r) for r in rows) + end


def test_appended_cut_and_rewritten(spark, tmp_path):
    path = tmp_path / "root/sessions/rollout-a.jsonl"
    path.parent.mkdir(parents=True)
    scan = _Scans(spark, tmp_path / "root", tmp_path)
    path.write_text(_text(META, TURN, _use(1)))
    (first,) = scan()
    lineage = first[4]
    assert first[:4] == (3, "1", ["session_meta", "turn_context"], "one") and (scan.cursors[0]["offset"], scan.cursors[0]["ordinal"]) == (path.stat().st_size, 3)
    assert scan() == []  # nothing has changed
    with path.open("a") as f:
        f.write("not json\n" + _text(_use(2)) + json.dumps(_use(3))[:20])
    assert scan() == [(5, "2", ["session_meta", "turn_context"], "one", lineage)]  # context of an earlier scan; half a line waits
    before = scan.cursors[0]["offset"]
    with path.open("a") as f:
        f.write(json.dumps(_use(3))[20:])
    assert [r[:2] for r in scan()] == [(6, "3")] and scan.cursors[0]["offset"] == before  # whole, but without its end: read again next time
    with path.open("a") as f:
        f.write("\n" + _text({**META, "payload": META["payload"] | {"cwd": "/srv/two"}}, _use(4)))
    assert [r[:4] for r in scan()] == [(6, "3", ["session_meta", "turn_context"], "one"), (8, "4", ["turn_context", "session_meta"], "two")] and scan.cursors[0]["ordinal"] == 8
    path.write_text(_text(META, _use(5)))  # cut off and rewritten
    (anew,) = scan()
    assert anew[:4] == (2, "5", ["session_meta"], "one") and anew[4] != lineage and scan.cursors[0]["lineage"] == anew[4]
    text = path.read_text()
    path.write_text(text.replace('"s"', '"z"') + _text(_use(6)))  # longer, but other bytes before the cursor
    rows = scan()
    assert [r[:2] for r in rows] == [(2, "5"), (3, "6")] and len({r[4] for r in rows} | {lineage, anew[4]}) == 3


def test_long_lines(spark, tmp_path):
    folder = tmp_path / "root/sessions"
    folder.mkdir(parents=True)
    long = "x" * 5000
    (folder / "rollout-a.jsonl").write_text(_text(META, {"type": "response_item", "x": long}, _use(1)))
    (folder / "rollout-b.jsonl").write_text(_text(META, _use(2), {**_use(3), "x": long}, _use(4)))
    (folder / "rollout-c.jsonl").write_text(_text(META, _use(5)) + json.dumps({"type": "response_item", "x": long})[:-1])
    scan = _Scans(spark, tmp_path / "root", tmp_path, most=2000)
    rows = scan()
    assert sorted(r[:2] for r in rows) == [(2, "5"), (3, "1")]  # nothing of b, which fails alone
    (failure,) = scan.failures
    assert failure["code"] == "record_limit" and len(scan.cursors) == 2 and failure["source_id"] not in {c["source_id"] for c in scan.cursors}
    assert scan() == [] and len(scan.failures) == 1  # an unchanged bad source isn't read again
    with (folder / "rollout-c.jsonl").open("a") as f:
        f.write("}\n" + _text(_use(6)))
    (folder / "rollout-b.jsonl").write_text(_text(META, _use(2)))
    assert sorted(r[:2] for r in scan()) == [(2, "2"), (4, "6")] and scan.failures == [] and len(scan.cursors) == 3


def test_same_as_whole_files(spark, tmp_path):
    """Cut anywhere, scans add up to what the whole files give."""
    rng = random.Random(4)
    folder = tmp_path / "root/sessions"
    folder.mkdir(parents=True)
    texts = {f"rollout-{i}.jsonl": _text(META, *(rng.choice([TURN, META, _use(n), {"type": "response_item"}]) for n in range(30))) for i in range(6)}
    scan, done, got = _Scans(spark, tmp_path / "root", tmp_path), dict.fromkeys(texts, 0), set()
    for last in (False, False, True):
        for name, text in texts.items():
            upto = len(text) if last else rng.randint(done[name], len(text))
            with (folder / name).open("a") as f:
                f.write(text[done[name] : upto])
            done[name] = upto
        got |= {(r[0], r[1], tuple(r[2]), r[3]) for r in scan()}
    whole = jsonl.evidence(spark, "codex", str(tmp_path / "root")).where("is_usage").collect()
    first = min(r["ordinal"] for r in whole) - min(g[0] for g in got)
    assert got == {(r["ordinal"] - first, json.loads(r["data"])["payload"]["info"]["last_token_usage"]["input_tokens"], tuple(json.loads(c["data"])["type"] for c in r["context"]), r["directory_name"]) for r in whole}
    assert tail.scan(spark, "pi", str(tmp_path / "nowhere")).evidence.count() == 0
