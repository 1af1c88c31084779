"""Directories and remotes as columns: absolute paths made plain, labels without a home's owner, identities of repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Absolute Windows and UNC paths, and the roots below which a name is somebody's home.
WINDOWS = r"^(?:[A-Za-z]:[/\\]|\\\\|//)"
HOMES = r"(?i)^(?:.:)?(?:/home/|/Users/|/var/home/|/Documents and Settings/)([^/]+)(/.*)?$"
#: Ports that a scheme doesn't need to name.
DEFAULT_PORTS = {"ssh": "22", "https": "443", "http": "80"}
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@]*@)?([^/:?#]+)(?::([0-9]*))?([^?#]*)"
_SHORT = r"^([^/:]*):(.*)$"


def _joined(path: Column) -> Column:
    """The path's parts without empty and . ones, .. taking the one before it away."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    above = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", above(acc)).otherwise(F.concat(acc, F.array(p)))), "/")


def cleaned(path: Column) -> Column:
    """An absolute slash path in its shortest form."""
    return F.concat(F.lit("/"), _joined(path))


def directory(recorded: Column) -> Column:
    """A recorded directory as a plain absolute path with slashes; null if it isn't absolute."""
    text = F.trim(recorded)
    slashes = F.replace(text, F.lit("\\"), F.lit("/"))
    windows = F.when(F.startswith(slashes, F.lit("//")), F.concat(F.lit("//"), _joined(slashes))).otherwise(_joined(slashes))
    return F.when(text.rlike(WINDOWS), windows).when(F.startswith(text, F.lit("/")), cleaned(text))


def home_relative(path: Column, home: str = "") -> Column:
    """The path with ~ for the given home, or for anybody's below the usual roots."""
    value = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"[\x00-\x1F\x7F]", "")
    user, rest = F.regexp_extract(value, HOMES, 1), F.regexp_extract(value, HOMES, 2)
    out = F.when(~user.isin("", ".", ".."), F.concat(F.lit("~"), rest)).otherwise(value)
    if own := home.replace("\\", "/").rstrip("/"):
        same = F.lit(own).rlike(WINDOWS) | value.rlike(WINDOWS)
        begins = F.when(same, F.startswith(F.lower(value), F.lit(own.lower()))).otherwise(F.startswith(value, F.lit(own)))
        suffix = F.substr(value, F.lit(len(own) + 1))
        out = F.when(begins & ((suffix == "") | F.startswith(suffix, F.lit("/"))), F.concat(F.lit("~"), suffix)).otherwise(out)
    return out


def _without_git(name: Column) -> Column:
    return F.regexp_replace(name, r"\.git$", "")


def remote_identity(remote: Column) -> Column:
    """host[:port]/path of a git remote (URL or user@host:path), local:path of one on this machine; null if it is neither.
    Hosts are lower-case; users, default ports, outer slashes and .git are left out."""
    text = F.trim(remote)
    scheme, host, port, path = (F.regexp_extract(text, _URL, i) for i in range(1, 5))
    usual = F.lit("")
    for name, number in DEFAULT_PORTS.items():
        usual = F.when(scheme == name, number).otherwise(usual)
    with_port = F.concat(F.lower(host), F.when((port != "") & (port != usual), F.concat(F.lit(":"), port)).otherwise(""))
    short = F.lower(F.element_at(F.split(F.regexp_extract(text, _SHORT, 1), "@"), -1))
    file = F.regexp_extract(text, r"^file://[^/]*(/.*)$", 1)
    named = lambda at, name: F.when((at != "") & (name != ""), F.concat(at, F.lit("/"), name))
    trimmed = lambda c: _without_git(F.regexp_replace(F.trim(c), "^/+|/+$", ""))
    local = lambda c: F.concat(F.lit("local:"), _without_git(cleaned(c)))
    return (
        F.when(F.startswith(text, F.lit("/")), local(text)).when(file != "", local(file)).when(text.rlike(_URL), named(with_port, trimmed(path)))
        .when(text.rlike(_SHORT), named(short, trimmed(F.regexp_extract(text, _SHORT, 2))))
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
