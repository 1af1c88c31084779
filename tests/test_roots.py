"""Where files are looked for."""

import json

from usagelake.sources import roots
from usagelake.sources.roots import Root

from .test_evidence import _claude, _codex, _lines


def test_defaults_and_variables():
    assert roots.resolve({"HOME": "/home/me"}) == {"opencode": Root("/home/me/.local/share/opencode"), "pi": Root("/home/me/.pi/agent/sessions"), "codex": Root("/home/me/.codex"), "claude-code": Root("/home/me/.claude")}
    found = roots.resolve({"HOME": "/h", "CODEX_HOME": " rel/../c ", "XDG_DATA_HOME": "/data", "CLAUDE_CONFIG_DIR": "  "}, base="/work")
    assert (found["codex"], found["opencode"], found["claude-code"]) == (Root("/work/c"), Root("/data/opencode"), Root("/h/.claude"))
    assert roots.resolve({"CODEX_HOME": "/c"}) == {"codex": Root("/c")} and roots.resolve({}) == {}


def test_override():
    folders = {"/x/pi", "/x/codex"}
    find = lambda harnesses: roots.resolve({"HOME": "/h"}, harnesses, " /x/./ ", is_folder=folders.__contains__)
    assert find(["pi", "codex", "opencode"]) == {"pi": Root("/x/pi", True), "codex": Root("/x/codex", True)}
    assert find(["opencode"]) == {"opencode": Root("/x", True)} and find(["pi"]) == {"pi": Root("/x/pi", True)} and find(["opencode", "claude-code"]) == {}


def test_files_of_an_override(spark, tmp_path):
    _lines(tmp_path / "codex/deep/er/rollout-a.jsonl", _codex("s", ["t"], [3]))
    _lines(tmp_path / "claude-code/b.jsonl", [_claude("c1", "2026-01-02T00:00:01Z", input_tokens=10, output_tokens=5)])
    found = roots.all_evidence(spark, roots.resolve({}, source_dir=str(tmp_path)), home="/srv").where("is_usage").collect()
    assert {(r["harness"], r["directory_name"]) for r in found} == {("codex", "x"), ("claude-code", "")} and all(json.loads(r["data"]) for r in found)
