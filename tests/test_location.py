"""Directories, remotes, locations, fact tables and delivery batches on small rows."""

from pyspark.sql import functions as F

from usagelake.functions import location as L
from usagelake.functions.text import chart_label
from usagelake.operators import facts
from usagelake.operators.delivery import batched
from usagelake.operators.location import located
from usagelake.schemas import FACT


def _each(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", make(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def test_directories(spark):
    found = _each(spark, ["/a//b/./c/..", "C:\\Users\\x\\y", "//srv/share/../z", "rel/a", None, " /a/ ", "/.."], L.directory)
    assert found == ["/a/b", "C:/Users/x/y", "//srv/z", None, None, "/a", "/"]
    found = _each(spark, ["/home/me/x", "/home/me", "/Users/Me/x", "D:/Users/me/x", "/srv/x", "/home/../x", "/var/home/u/a"], L.home_relative)
    assert found == ["~/x", "~", "~/x", "~/x", "/srv/x", "/home/../x", "~/a"]
    assert _each(spark, ["/opt/own/x", "/opt/owner"], lambda c: L.home_relative(c, "/opt/own")) == ["~/x", "/opt/owner"]


def test_remotes(spark):
    given = ["https://User:pw@Host.org:443/a/b.git", "ssh://git@host:2222/a/b", "ssh://git@host:22/a/b/", "git@Host:a/b.git", "git://host:9418/x", "/srv/r.git", "file:///srv/r.git", "nothing", "", None, "https://host/", "http://h:80//a//"]
    assert _each(spark, given, L.remote_identity) == ["host.org/a/b", "host:2222/a/b", "host/a/b", "host/a/b", "host:9418/x", "local:/srv/r", "local:/srv/r", None, None, None, None, "h/a"]


def test_location_by_rank(spark):
    rows = spark.createDataFrame([("/w/p", "git@h:a/b", "git@h:c/d", "/w/p/.git", "x"), ("/w/p", None, "git@h:c/d", "/w/p/.git", "x"), ("/w/p", None, None, "/w/p/.git", "x"), ("/w/p", None, None, "", "x"), ("w", None, None, None, None)], "d string, r string, g string, c string, p string")
    found = located(rows, "d", "r", "g", "c", "p").collect()
    assert [r["repository_source"] for r in found] == ["harness", "git-remote", "git-common-dir", "opencode-project", ""]
    assert [r["repository_name"] for r in found] == ["b", "d", "p", "p", ""] and [r["location_conflict"] for r in found] == [True, False, False, False, False]
    assert found[4]["directory_key"] == found[4]["repository_key"] == ""


def test_chart_labels_count_utf16(spark):
    assert _each(spark, ["a" * 17, "a" * 18, "\U0001f600" * 9, "ab"], chart_label) == ["a" * 17, "a" * 15 + "…", "\U0001f600" * 7 + "…", "ab"]


def test_delivery_batches(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 5, 1, 50, 1, 1, 1])] + [("b", 9, None)], "q string, s long, n long")
    found = sorted(map(tuple, batched(rows, F.col("q"), "s", F.col("n"), most_rows=3, most_bytes=10).collect()))
    assert found == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("a", 5, 3), ("a", 6, 3), ("b", 9, 0)]


def test_fact_table_skips_days(spark, tmp_path):
    values = {"string": F.lit("x"), "bigint": F.col("id") * 43_200_000, "boolean": F.lit(True)}
    rows = spark.range(10).select(*(values[f.dataType.simpleString()].alias(f.name) for f in FACT.fields)).withColumns({"dataset_id": F.lit("default"), "generation": F.lit(1).cast("bigint")})
    facts.write_facts(rows, str(tmp_path / "facts"))
    table = facts.read_facts(spark, str(tmp_path / "facts"))
    found = facts.in_days(table, 86_400_000, 2 * 86_400_000)
    assert table.count() == 10 and sorted({r["day"] for r in found.collect()}) == ["1970-01-02", "1970-01-03"]
