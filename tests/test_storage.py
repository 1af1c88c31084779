"""What tables between stages take and leave on disk."""

import os

import pytest
from pyspark.sql import functions as F

from usagelake import catalog, native, storage
from usagelake.operators.process import process

DATA = "/root/testdata/sf0.01"


def _files(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names}


def _added(spark, before):
    """Bytes of what is there now and wasn't before."""
    return sum(n for f, n in _files(spark).items() if f not in before)


def test_scratch_goes_and_results_stay(spark):
    rows, before = spark.range(1000).withColumn("k", F.col("id") % 7), _files(spark)
    with storage.Scratch() as own:
        assert own.stored(rows).count() == own.dealt(rows, "k").count() == 1000
        assert own.dealt(rows, "k").where("k = 3").count() == 143
        result = storage.stored(own.stored(rows).groupBy("k").count())
        assert _added(spark, before) > 0
    left = [f for f in _files(spark) if f not in before]
    assert left and all("/stored-" in f for f in left)
    assert {r["k"] for r in result.collect()} == set(range(7))


def test_setting_is_put_back(spark):
    spark.conf.set(storage._CLEANUP, "false")
    try:
        storage.stored(spark.range(3))
        assert spark.conf.get(storage._CLEANUP) == "false"
        with pytest.raises(Exception, match="(?i)divi"):
            storage.stored(spark.range(3).select(F.expr("1 / (id - id)").alias("x")))
        assert spark.conf.get(storage._CLEANUP) == "false"
    finally:
        spark.conf.unset(storage._CLEANUP)


def test_decisions_of_forks_need_no_join(spark):
    """Candidates go through the decisions and aren't joined with them; what stays is compressed, and evidence doesn't stay."""
    before = _files(spark)
    found = native.fork_decisions(spark, DATA)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert _added(spark, before) < 400 * found.count()


def test_codes_count_facts_as_bytes(spark):
    """What goes through the shuffle of the distinct count is 32 bytes of a fact's id, not its text, and nothing is joined before."""
    found = catalog.QUERIES["fork_codes"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "count(distinct unhex" in plan


def test_projection_leaves_results_only(spark):
    evidence, before = native.evidence(spark, DATA), _files(spark)
    made = process(evidence)
    rows = made.outcomes.count()
    assert rows == 10_000
    assert _added(spark, before) < 500 * rows
