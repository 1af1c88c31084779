"""Where each harness keeps its files, and how that is overridden."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..schemas import HARNESSES
from . import jsonl, sqlite

#: The variable that names a harness's folder, else the folder below home, and what in it is the root.
PLACES = {"opencode": ("XDG_DATA_HOME", ".local/share", "opencode"), "pi": ("", ".pi", "agent/sessions"), "codex": ("CODEX_HOME", ".codex", ""), "claude-code": ("CLAUDE_CONFIG_DIR", ".claude", "")}


@dataclass(frozen=True)
class Root:
    """whole: files are looked for below the path itself, not in the folders that the harness has there."""

    path: str
    whole: bool = False


def resolve(environment: Mapping[str, str], harnesses: Iterable[str] = HARNESSES, source_dir: str = "", base: str = "/", is_folder: Callable[[str], bool] = os.path.isdir) -> dict[str, Root]:
    """The root of each harness that has one. source_dir stands for all: its child of the harness's name if there is one; else itself,
    but only where one harness is asked for. Relative paths are taken from base; blank variables count as unset."""
    harnesses, value = list(harnesses), lambda name: environment.get(name, "").strip()
    if override := source_dir.strip():
        top = posixpath.normpath(posixpath.join(base, override))
        children = {h: Root(f"{top}/{h}", True) for h in harnesses if is_folder(f"{top}/{h}")}
        return children or ({harnesses[0]: Root(top, True)} if len(harnesses) == 1 else {})
    out = {}
    for h in harnesses:
        name, folder, inside = PLACES[h]
        configured = value(name) if name else ""
        if configured or value("HOME"):
            out[h] = Root(posixpath.normpath(posixpath.join(base, configured or posixpath.join(value("HOME"), folder), inside)))
    return out


def all_evidence(spark: SparkSession, roots: Mapping[str, Root | str], home: str = "") -> DataFrame:
    """Evidence of all harnesses that have a root, in their fixed order. home shortens directories below it in labels."""
    found = []
    for h in HARNESSES:
        if h in roots:
            root = roots[h] if isinstance(roots[h], Root) else Root(roots[h])
            found.append(sqlite.evidence(spark, root.path, home) if h == "opencode" else jsonl.evidence(spark, h, root.path, home, root.whole))
    if not found:
        raise ValueError("no harness has a root")
    return reduce(DataFrame.unionByName, found)
