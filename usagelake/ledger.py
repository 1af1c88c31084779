"""Facts, scopes and edges made from the driver's tables, so that every operator has data to run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import tuple_hash

DATASET, ACTIVE = "default", 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(n: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def facts(spark: SparkSession, sf_dir: str, estimated: bool = False) -> DataFrame:
    """The active generation's confirmed or estimated facts: one for each event."""
    return _facts(spark, sf_dir).where(F.col("is_estimate") == estimated)


def all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all generations: those of even events also stand in the retained generation 1."""
    active = _facts(spark, sf_dir)
    return active.unionByName(active.where("event_id % 2 = 0").withColumn("generation", F.lit(1).cast("bigint")))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, user, k = F.col("event_id"), F.col("user_id"), F.get_json_object("props", "$.k").cast("bigint")
    harness = _pick(e % 4, "codex", "pi", "opencode", "claude-code")
    provider = F.when(F.col("event_type") == "view", "anthropic").when(F.col("event_type") == "click", "openai").when(F.col("event_type") == "error", "fireworks").when(F.col("event_type") == "purchase", "google").otherwise("unknown")
    session = F.concat(F.lit("s-"), user.cast("string"), F.lit("-"), (e % 3).cast("string"))
    blank = lambda when, text: F.when(when, "").otherwise(text)
    tokens = {"input_tokens": F.floor(F.col("value") * 100), "output_tokens": k * 7 % 50, "reasoning_tokens": e % 5, "cache_read_tokens": k * 31 % 200, "cache_write_tokens": user % 9}
    columns = {
        "dataset_id": F.lit(DATASET), "event_id": e, "harness": harness, "session_native_id": session, "session_id": tuple_hash("session-v1", "default", harness, session),
        "message_native_id": F.concat(F.lit("m-"), e.cast("string")), "occurred_at_ms": F.unix_millis(F.col("ts").cast("timestamp")), "provider": provider,
        "model": F.concat(F.lit("model-"), (k % 12).cast("string")), "countable": e % 11 != 0, "is_estimate": e % 13 == 0, **tokens, "total_tokens": sum(list(tokens.values())[1:], tokens["input_tokens"]),
        "directory_key": blank(user % 7 == 0, F.concat(F.lit("d"), (user % 10).cast("string"))), "directory_name": blank(user % 11 == 0, F.concat(F.lit("dir-"), (user % 10).cast("string"))),
        "repository_key": blank(user % 6 == 0, F.concat(F.lit("r"), (user % 5).cast("string"))), "repository_name": blank(user % 6 == 0, F.concat(F.lit("repo-"), (user % 5).cast("string"))),
    }
    return table(spark, sf_dir, "events").select(*(c.alias(n) for n, c in columns.items()), F.lit(ACTIVE).cast("bigint").alias("generation"))


#: The same in the oracle's SQL; a query begins with it.
ALL_FACTS_SQL = """WITH base AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
plain AS (SELECT 'default' AS dataset_id, event_id,
  CASE event_id % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'pi' WHEN 2 THEN 'opencode' ELSE 'claude-code' END AS harness,
  's-' || user_id || '-' || (event_id % 3) AS session_native_id, 'm-' || event_id AS message_native_id, epoch_us(ts) // 1000 AS occurred_at_ms,
  CASE event_type WHEN 'view' THEN 'anthropic' WHEN 'click' THEN 'openai' WHEN 'error' THEN 'fireworks' WHEN 'purchase' THEN 'google' ELSE 'unknown' END AS provider,
  'model-' || (k % 12) AS model, event_id % 11 <> 0 AS countable, event_id % 13 = 0 AS is_estimate,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, k * 7 % 50 AS output_tokens, event_id % 5 AS reasoning_tokens, k * 31 % 200 AS cache_read_tokens, user_id % 9 AS cache_write_tokens,
  CASE WHEN user_id % 7 = 0 THEN '' ELSE 'd' || (user_id % 10) END AS directory_key, CASE WHEN user_id % 11 = 0 THEN '' ELSE 'dir-' || (user_id % 10) END AS directory_name,
  CASE WHEN user_id % 6 = 0 THEN '' ELSE 'r' || (user_id % 5) END AS repository_key, CASE WHEN user_id % 6 = 0 THEN '' ELSE 'repo-' || (user_id % 5) END AS repository_name
  FROM base),
whole AS (SELECT *, input_tokens + output_tokens + reasoning_tokens + cache_read_tokens + cache_write_tokens AS total_tokens,
  sha256('["session-v1","default","' || harness || '","' || session_native_id || '"]') AS session_id FROM plain),
all_facts AS (SELECT *, CAST(2 AS BIGINT) AS generation FROM whole UNION ALL SELECT *, CAST(1 AS BIGINT) FROM whole WHERE event_id % 2 = 0)"""
FACTS_SQL = ALL_FACTS_SQL + ", facts AS (SELECT * FROM all_facts WHERE generation = 2 AND NOT is_estimate), estimates AS (SELECT * FROM all_facts WHERE generation = 2 AND is_estimate)"
