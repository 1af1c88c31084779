"""Where usage happened: a directory and a repository for each row.

A repository is named by the first of: the remote that the record gives, the directory's remote, its common git folder, the
project that the harness knows. What git says about a directory comes in as columns; asking it is the collecting host's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import location as L
from ..functions.text import location_label


def _hash(kind: str, c: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}:"), c), 256)


def located(rows: DataFrame, directory: str, remote: str | None = None, git_remote: str | None = None, git_common_dir: str | None = None, project: str | None = None, home: str = "") -> DataFrame:
    """rows with directory_key, directory_name (the last part of the path, ~ for a home), repository_key, repository_name, repository_source (empty: unknown) and
    location_conflict (the record and git name different remotes). The other arguments name columns that rows may have."""
    given = lambda name: F.col(name) if name else F.lit(None).cast("string")
    path = L.directory(given(directory))
    recorded, found = L.remote_identity(given(remote)), L.remote_identity(given(git_remote))
    common, known = F.nullif(given(git_common_dir), F.lit("")), F.nullif(given(project), F.lit(""))
    name = lambda c: location_label(L.base_name(c))
    parent = F.element_at(F.split(common, "/"), -2)
    choices = [
        (recorded, "harness", _hash("remote", recorded), name(recorded)), (found, "git-remote", _hash("remote", found), name(found)),
        (common, "git-common-dir", _hash("git-common-dir", common), location_label(parent)), (known, "opencode-project", _hash("opencode-project", known), F.coalesce(name(path), F.lit("unknown"))),
    ]
    pick = lambda at: F.coalesce(*(F.when(c[0].isNotNull(), F.lit(c[1]) if at == 1 else c[at]) for c in choices), F.lit(""))
    return rows.withColumns({
        "directory_key": F.coalesce(_hash("directory", path), F.lit("")), "directory_name": F.when(path.isNotNull(), name(L.home_relative(path, home))).otherwise(""),
        "repository_key": pick(2), "repository_name": pick(3), "repository_source": pick(1), "location_conflict": F.coalesce(recorded != found, F.lit(False)),
    })


def session_locations(rows: DataFrame, sessions: DataFrame, projects: DataFrame, session: str = "session_native_id", home: str = "") -> DataFrame:
    """rows with the locations of their sessions. sessions: (id, directory, project_id and, where that isn't what identifies the
    project, project); projects: (id, vcs), of which only those under git count."""
    tracked = projects.where("vcs = 'git'").select(F.col("id").alias("project_id"), F.lit(True).alias("__tracked"))
    own = F.when(F.col("__tracked"), F.col("project" if "project" in sessions.columns else "project_id"))
    places = located(sessions.join(tracked, "project_id", "left").withColumn("__project", own), "directory", project="__project", home=home)
    columns = ("directory_key", "directory_name", "repository_key", "repository_name", "repository_source")
    joined = rows.drop(*columns).join(places.select(F.col("id").alias(session), *columns), session, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})
