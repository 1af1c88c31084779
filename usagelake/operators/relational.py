"""Set and store operators: semi-joins, insert-ignore, upsert, replacement by scope, keyset pages, generations, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """stored and those rows of new whose key it lacks; of new rows with equal keys, the first in order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = new.withColumn("__n", first).where("__n = 1").drop("__n").join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with new's rows in place of those with equal keys."""
    return stored.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def replace_scopes(stored: DataFrame, new: DataFrame, scopes: DataFrame, scope: str = "scope") -> DataFrame:
    """stored without the scopes' rows, and new."""
    return stored.join(scopes.select(scope).distinct(), scope, "left_anti").select(*new.columns).unionByName(new)


def keyset_page(rows: DataFrame, keys: tuple[str, str], after: tuple | None, size: int) -> DataFrame:
    """The next rows after a pair of keys, in their order."""
    a, b = map(F.col, keys)
    if after is not None:
        rows = rows.where((a > F.lit(after[0])) | ((a == F.lit(after[0])) & (b > F.lit(after[1]))))
    return rows.orderBy(a, b).limit(size)


def active_view(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows of each dataset's active generation. metadata: (dataset_id, generation), a row for each dataset."""
    return rows.join(metadata.select("dataset_id", "generation"), ["dataset_id", "generation"], "left_semi")


def generation_guard(metadata: DataFrame, generations: DataFrame) -> DataFrame:
    """For each dataset its active generation, how many generations are active or being built, and the highest."""
    joined = metadata.select("dataset_id", "generation").join(generations.select("dataset_id", F.col("generation").alias("g"), "state"), "dataset_id", "left")
    count = lambda state: F.count(F.when(F.col("state") == state, 1))
    return joined.groupBy("dataset_id", "generation").agg(count("active").alias("n_active"), count("building").alias("n_building"), F.max("g").alias("highest"), F.max(F.when(F.col("g") == F.col("generation"), F.col("state"))).alias("state"))


def receipt(items: DataFrame, evidence: DataFrame, scopes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A batch's items with the disposition of each; pending where there is none of the scope's revision."""
    known = outcomes.select("evidence_id", "disposition", "code", F.col("revision").alias("outcome_revision"))
    joined = items.join(evidence.select("evidence_id", "scope"), "evidence_id").join(scopes.select("scope", "revision"), "scope").join(known, "evidence_id", "left")
    current = F.coalesce(F.col("outcome_revision") == F.col("revision"), F.lit(False))
    return joined.select("sequence", "evidence_id", "scope", F.when(current, F.col("disposition")).otherwise("pending").alias("disposition"), F.when(current, F.col("code")).otherwise("").alias("code"))


def status_counts(scopes: DataFrame) -> DataFrame:
    """One row: scopes that wait, those that failed, and the earliest retry (0: none)."""
    waits = F.col("processed_revision") != F.col("revision")
    failed = waits & (F.col("error") != "")
    return scopes.agg(F.count_if(waits).alias("pending"), F.count_if(failed).alias("failed"), F.coalesce(F.min(F.when(failed, F.col("retry_at_ms"))), F.lit(0)).alias("retry_at_ms"))


def eligible(scopes: DataFrame, target_generation: int, now_ms: int, after: tuple | None = None, size: int = 32) -> DataFrame:
    """Scopes to process next: changed or of another generation, not waiting for a retry; a keyset page by (revision, scope)."""
    work = ((F.col("processed_revision") != F.col("revision")) | (F.col("generation") != target_generation)) & (F.col("retry_at_ms") <= now_ms)
    return keyset_page(scopes.where(work), ("revision", "scope"), after, size)


def unresolved(outcomes: DataFrame, generation: int | None = None) -> DataFrame:
    """One row: records of which nothing could be made. outcomes: of one dataset; with generation, of that one only."""
    rows = outcomes if generation is None else outcomes.where(F.col("generation") == generation)
    return rows.agg(F.count_if((F.col("disposition") == "ambiguous") & (F.col("code") == "unusable_usage")).alias("unresolved"))


def failed(scopes: DataFrame, which: DataFrame, code: str, now_ms: int) -> DataFrame:
    """scopes with the given ones' failure: its code, one more attempt, and the instant of the next one."""
    hit = which.select("scope").distinct().withColumn("__hit", F.lit(True))
    rows = scopes.join(hit, "scope", "left").withColumn("attempts", F.col("attempts") + F.coalesce(F.col("__hit").cast("int"), F.lit(0)))
    return rows.withColumns({"error": F.when(F.col("__hit"), code).otherwise(F.col("error")), "retry_at_ms": F.when(F.col("__hit"), retry_at(F.col("attempts") - 1, now_ms)).otherwise(F.col("retry_at_ms"))}).select(*scopes.columns)


def retry_at(attempts: Column, now_ms: int) -> Column:
    """The instant of the next attempt: 2 ^ attempts seconds later, 64 at most."""
    return F.lit(now_ms) + F.lit(1000) * F.pow(F.lit(2), F.least(attempts, F.lit(6))).cast("bigint")


def provenance(edges: DataFrame) -> DataFrame:
    """The set of (fact_id, evidence_id)."""
    return edges.select("fact_id", "evidence_id").distinct()


def options_with_selected(options: DataFrame, selected: list[str]) -> DataFrame:
    """(key, name): the options and selected keys that are missing among them."""
    chosen = options.sparkSession.createDataFrame([(k,) for k in selected], "key string")
    return options.select("key", "name").unionByName(chosen.join(options, "key", "left_anti").select("key", F.when(F.col("key") == "", "unknown").otherwise(F.col("key")).alias("name")))


def status(scopes: DataFrame, outcomes: DataFrame, metadata: DataFrame) -> DataFrame:
    """The one row that a client polls. metadata: (dataset_id, generation, target_generation, input_revision), one row. With it, how many
    scopes wait (for a revision or for the target generation), how many of these failed, the earliest retry (0: none), and how many
    records couldn't be read."""
    target = metadata.select("target_generation").first()[0]
    waits = (F.col("processed_revision") != F.col("revision")) | (F.col("generation") != target)
    counts = status_counts(scopes.where(waits).withColumns({"revision": F.lit(1), "processed_revision": F.lit(0)}))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(metadata).join(one(counts), "__one").join(one(unresolved(outcomes)), "__one").drop("__one")


def filter_options(options: DataFrame, selected: list[str], missing_name: str = "", search: str = "") -> DataFrame:
    """(key, name) in the order of names as people sort them: options and selected keys that are missing among them, whose names
    hold the searched text in any case. A missing key is named missing_name, or itself; unknown stays unknown."""
    chosen = options.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(selected)], "key string").join(options, "key", "left_anti")
    name = F.when(F.col("key").isin("", "unknown"), "unknown").otherwise(F.lit(missing_name) if missing_name else F.col("key"))
    rows = options.select("key", "name").unionByName(chosen.select("key", name.alias("name")))
    return rows.where(F.contains(F.lower("name"), F.lit(search.lower()))).orderBy(F.collate("name", "UNICODE"), "key")
