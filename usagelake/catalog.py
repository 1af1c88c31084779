"""All queries of the analytics engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ledger, native
from .functions import calendar, location, text
from .operators import context, dashboard, delivery, graph, outbox, relational, resolve
from .operators.location import session_locations
from .plans.query import Query, Selection, instants, normalize
from .streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: 2024-01-17T12:00:00Z, inside the events' month.
NOW = 1705492800000
UTC = dashboard.Clock(NOW)
ALL = Selection(period="all")


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


# Dashboard ------------------------------------------------------------------------------------------------------------
_SUMS = ", ".join(f"CAST(coalesce(sum({c}_tokens), 0) AS BIGINT) AS {c}" for c in dashboard.COUNTS)
_LOAD = "input_tokens + cache_read_tokens + cache_write_tokens"


def _sql_zone(zone: str) -> tuple[str, int]:
    """DuckDB takes names only: a fixed offset is added to UTC."""
    return ("UTC", int(zone[1:])) if zone.startswith("@") else (zone, 0)


def _sql_bucket(zone: str, unit: str) -> str:
    name, offset = _sql_zone(zone)
    shape = {"day": "%Y-%m-%d", "week": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}[unit]
    return f"strftime(date_trunc('{unit}', timezone('{name}', make_timestamptz(occurred_at_ms * 1000)) + INTERVAL {offset} SECOND), '{shape}')"


def _sql_where(q: Query, clock: dashboard.Clock) -> str:
    start, end = instants(q.selection, clock.now_ms, clock.zone)
    tests = ["countable"] + [f"occurred_at_ms >= {start}"] * (start is not None) + [f"occurred_at_ms < {end}"] * (end is not None)
    s = q.selection
    wanted = [("provider", s.providers), ("model", s.models), ("harness", s.harnesses), ("session_native_id", s.sessions)]
    if q.tab == "repo":
        wanted += [("coalesce(nullif(repository_key, ''), 'unknown')", q.repositories), ("coalesce(nullif(directory_key, ''), 'unknown')", q.directories)]
    tests += [f"{c} IN ({', '.join(f"'{v}'" for v in values)})" for c, values in wanted if values]
    return f"{'estimates' if q.quality == 'estimated' else 'facts'} WHERE {' AND '.join(tests)}"


def _sql_group(q: Query, clock: dashboard.Clock) -> list[str]:
    own = {"providers": ["provider"], "harnesses": ["harness"], "models": ["model"], "sessions": ["harness", "session_native_id"], "context": ["harness", "provider", "model"]}
    if q.tab == "tokens":
        return [_sql_bucket(clock.zone, q.selection.bucket)]
    return [f"coalesce(nullif({q.location_group}_key, ''), 'unknown')"] if q.tab == "repo" else own[q.tab]


def _sql_rows(q: Query, clock: dashboard.Clock) -> str:
    by = _sql_group(q, clock)
    key, where = " || ':' || ".join(by), _sql_where(q, clock)
    if q.tab == "context":
        return f"""SELECT harness || ':' || provider || ':' || model AS key, model AS name, harness, provider, model, max(latest) AS date, count(*) AS sessions,
  {', '.join(f'CAST(0 AS BIGINT) AS {c}' for c in (*dashboard.COUNTS, 'context'))}, CAST(sum(peak) // count(*) AS BIGINT) AS average_context,
  CAST(floor(median(peak)) AS BIGINT) AS median_context, max(peak) AS max_context, '' AS location_key, '' AS location_name, '[]' AS directory_names, false AS unknown_directory, '' AS repository_key, '' AS repository_name
  FROM (SELECT harness, provider, model, session_id, max({_LOAD}) AS peak, max(occurred_at_ms) AS latest FROM {where} GROUP BY ALL) GROUP BY harness, provider, model"""
    names = ", ".join(f"string_agg(DISTINCT {c}, ', ' ORDER BY {c}) AS {c}" for c in ("harness", "provider", "model"))
    if q.tab == "repo":
        label = f"coalesce(nullif(min({q.location_group}_name), ''), 'unknown')"
        only = lambda c: f"CASE WHEN count(DISTINCT repository_key) = 1 THEN min({c}) ELSE 'unknown' END AS {c}"
        where_columns = f"""{key} AS location_key, {label} AS location_name, CAST(to_json(coalesce(list_sort(list(DISTINCT directory_name) FILTER (directory_name <> '')), [])) AS VARCHAR) AS directory_names,
  bool_or(directory_key = '' OR directory_name = '') AS unknown_directory, {only('repository_key')}, {only('repository_name')}"""
    else:
        label, where_columns = by[-1], "'' AS location_key, '' AS location_name, '[]' AS directory_names, false AS unknown_directory, '' AS repository_key, '' AS repository_name"
    return f"""SELECT {key} AS key, {label} AS name, {names}, max(occurred_at_ms) AS date, count(DISTINCT session_id) AS sessions, {_SUMS}, max({_LOAD}) AS context,
  CAST(0 AS BIGINT) AS average_context, CAST(0 AS BIGINT) AS median_context, CAST(0 AS BIGINT) AS max_context, {where_columns} FROM {where} GROUP BY {', '.join(by)}"""


def _sql_ordered(q: Query, clock: dashboard.Clock, sort: str, direction: str, limit: str) -> str:
    column = dashboard.SORT_COLUMNS.get(sort, sort)
    return f"{ledger.FACTS_SQL}, grouped AS ({_sql_rows(q, clock)}) SELECT * FROM grouped ORDER BY {column} {direction}, key ASC {limit}"


def _facts(spark: SparkSession, sf_dir: str, q: Query) -> DataFrame:
    return ledger.facts(spark, sf_dir, q.quality == "estimated")


def _add_page(name: str, query: Query, clock: dashboard.Clock = UTC) -> None:
    q = normalize(query)
    _add(name, lambda s, d: dashboard.page(_facts(s, d, q), q, clock), _sql_ordered(q, clock, q.sort, q.direction, f"LIMIT {q.page_size} OFFSET {(q.page - 1) * q.page_size}"))


def _add_chart(name: str, query: Query, clock: dashboard.Clock = UTC) -> None:
    q = normalize(query)
    timeline = q.tab in ("tokens", "sessions")
    shown = replace(q, tab="tokens") if timeline else q
    sort = ("date", "ASC", "LIMIT 1000") if timeline else ("averageContext" if q.tab == "context" else "total", "DESC", "LIMIT 12")
    _add(name, lambda s, d: dashboard.chart(_facts(s, d, q), q, clock), _sql_ordered(shown, clock, *sort))


_SOME = Selection(period="all", providers=("anthropic", "openai"), harnesses=("codex", "pi"))
for _tab in ("providers", "harnesses", "models", "sessions", "tokens", "context", "repo"):
    _add_page(f"usage_{_tab}_all", Query(_tab, ALL))
    _add_page(f"usage_{_tab}_filtered", Query(_tab, _SOME))
    _add_chart(f"chart_{_tab}", Query(_tab, ALL))
    _q = normalize(Query(_tab, _SOME))
    _add(
        f"group_count_{_tab}",
        lambda s, d, q=_q: dashboard.group_count(_facts(s, d, q), q, UTC),
        f"{ledger.FACTS_SQL} SELECT count(*) AS n_groups FROM (SELECT DISTINCT {', '.join(_sql_group(_q, UTC))} FROM {_sql_where(_q, UTC)})",
    )
_add_page("usage_sessions_page2", Query("sessions", ALL, page=2))
_add_page("usage_sessions_ascending", Query("sessions", ALL, sort="name", direction="asc", page_size=200))
_add_page("usage_models_estimated", Query("models", ALL, quality="estimated"))
_add_page("usage_sessions_by_context", Query("sessions", ALL, sort="context"))
_add_page("usage_context_by_median", Query("context", ALL, sort="medianContext", direction="asc"))
_add_page("usage_repo_by_directory", Query("repo", ALL, location_group="directory"))
_add_page("usage_repo_unknown", Query("repo", ALL, repositories=("unknown", "r1")))
_add_page("usage_repo_directory_filter", Query("repo", ALL, directories=("unknown", "d3"), sort="model"))
_add_page("usage_one_session", Query("models", Selection(period="all", sessions=("s-8-0", "s-46-1"))))
for _zone_name, _zone in (("utc", "UTC"), ("los_angeles", "America/Los_Angeles"), ("sydney", "Australia/Sydney"), ("offset", "@19800")):
    for _unit in ("day", "week", "month", "year"):
        _add_page(f"timeline_{_unit}_{_zone_name}", Query("tokens", Selection(period="all", bucket=_unit), page_size=200), dashboard.Clock(NOW, _zone))
for _period in ("today", "yesterday", "week", "month", "year", "all"):
    _add_page(f"period_{_period}", Query("harnesses", Selection(period=_period)), dashboard.Clock(NOW, "America/Los_Angeles"))
_add_page("period_custom_days", Query("harnesses", Selection(period="today", day_from="2024-01-05", day_to="2024-01-09")), dashboard.Clock(NOW, "Australia/Sydney"))
for _quality in ("confirmed", "estimated"):
    _q = normalize(Query("tokens", ALL, quality=_quality))
    _add(f"summary_{_quality}", lambda s, d, q=_q: dashboard.summary(_facts(s, d, q), q, UTC), f"{ledger.FACTS_SQL} SELECT {_SUMS}, count(DISTINCT session_id) AS sessions, count(*) AS facts FROM {_sql_where(_q, UTC)}")
_add("synced_sessions", lambda s, d: dashboard.synced_sessions(ledger.facts(s, d)), f"{ledger.FACTS_SQL} SELECT count(DISTINCT session_id) AS synced_sessions FROM facts WHERE countable")

_MODELS = normalize(Query("models", ALL))
_FACET_QUERY = normalize(Query("repo", replace(_SOME, models=("model-1", "model-2", "model-3")), repositories=("unknown", "r1", "r2")))


def _sql_facet(name: str, search: str = "") -> str:
    column, q = dashboard.FACETS[name], _FACET_QUERY
    free = replace(q, selection=replace(q.selection, **{name: ()})) if hasattr(q.selection, name) else replace(q, **{name: ()})
    if name in ("repositories", "directories"):
        label = column.replace("_key", "_name")
        return f"""{ledger.FACTS_SQL} SELECT coalesce(nullif({column}, ''), 'unknown') AS key, coalesce(nullif(min({label}), ''), 'unknown') AS name FROM {_sql_where(free, UTC)} GROUP BY {column} ORDER BY 1, 2 LIMIT 1000"""
    more = f" AND instr(lower({column}), lower('{search}')) > 0" if search else ""
    return f"{ledger.FACTS_SQL} SELECT DISTINCT {column} AS key, {column} AS name FROM {_sql_where(free, UTC)}{more} ORDER BY 1 LIMIT {100 if name == 'sessions' else 1000}"


for _name in dashboard.FACETS:
    _add(f"facet_{_name}", lambda s, d, n=_name: dashboard.facet(ledger.facts(s, d), _FACET_QUERY, UTC, n), _sql_facet(_name))
_add("facet_session_search", lambda s, d: dashboard.facet(ledger.facts(s, d), _FACET_QUERY, UTC, "sessions", "S-1"), _sql_facet("sessions", "S-1"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["usage_sessions_all"](spark, sf_dir)


# Generations, scopes and outcomes -------------------------------------------------------------------------------------
def _metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ledger.DATASET, 2)], "dataset_id string, generation long")


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.active_view(ledger.all_facts(spark, sf_dir), _metadata(spark))
    return rows.groupBy("harness", "is_estimate").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("total"))


_add("active_generation_view", _active, ledger.ALL_FACTS_SQL + " SELECT harness, is_estimate, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS total FROM all_facts JOIN (SELECT 'default' AS dataset_id, 2 AS generation) m USING (dataset_id, generation) GROUP BY ALL")


def _guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.all_facts(spark, sf_dir).select("dataset_id", "generation").distinct().withColumn("state", F.when(F.col("generation") == 2, "active").otherwise("retained"))
    return relational.generation_guard(_metadata(spark), found)


_add("generation_guard", _guard, ledger.ALL_FACTS_SQL + """, g AS (SELECT DISTINCT dataset_id, generation, CASE generation WHEN 2 THEN 'active' ELSE 'retained' END AS state FROM all_facts), m AS (SELECT 'default' AS dataset_id, CAST(2 AS BIGINT) AS generation)
SELECT m.dataset_id, m.generation, count(*) FILTER (state = 'active') AS n_active, count(*) FILTER (state = 'building') AS n_building, max(g.generation) AS highest, max(state) FILTER (g.generation = m.generation) AS state FROM m LEFT JOIN g ON g.dataset_id = m.dataset_id GROUP BY m.dataset_id, m.generation""")


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = ledger.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("revision"))
    u = F.col("user_id")
    return users.select(
        F.concat(F.lit("scope-"), u.cast("string")).alias("scope"), "revision", (F.col("revision") - (u % 3 == 0).cast("long")).alias("processed_revision"),
        F.when(u % 10 == 0, 1).otherwise(2).cast("long").alias("generation"), F.when(u % 9 == 0, "broken").otherwise("").alias("error"), (u * 100).alias("retry_at_ms"),
    )


_SCOPES_SQL = """WITH scopes AS (SELECT 'scope-' || user_id AS scope, count(*) AS revision, count(*) - CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS processed_revision,
CAST(CASE WHEN user_id % 10 = 0 THEN 1 ELSE 2 END AS BIGINT) AS generation, CASE WHEN user_id % 9 = 0 THEN 'broken' ELSE '' END AS error, user_id * 100 AS retry_at_ms FROM events GROUP BY user_id)"""
_add("status_counts", lambda s, d: relational.status_counts(_scopes(s, d)), _SCOPES_SQL + """ SELECT count(*) FILTER (processed_revision <> revision) AS pending, count(*) FILTER (processed_revision <> revision AND error <> '') AS failed,
CAST(coalesce(min(retry_at_ms) FILTER (processed_revision <> revision AND error <> ''), 0) AS BIGINT) AS retry_at_ms FROM scopes""")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ledger.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "ambiguous").otherwise("processed").alias("disposition"), F.when(F.col("o_orderstatus") == "P", "unusable_usage").otherwise("").alias("code"))
    scopes = _scopes(spark, sf_dir)
    metadata = scopes.agg(F.max("revision").alias("input_revision")).select(F.lit(ledger.DATASET).alias("dataset_id"), F.lit(2).cast("long").alias("generation"), F.lit(2).cast("long").alias("target_generation"), "input_revision")
    return relational.status(scopes, o, metadata)


_add("status", _status, _SCOPES_SQL + f""" SELECT '{ledger.DATASET}' AS dataset_id, CAST(2 AS BIGINT) AS generation, CAST(2 AS BIGINT) AS target_generation, max(revision) AS input_revision, count(*) FILTER (waits) AS pending, count(*) FILTER (waits AND error <> '') AS failed,
CAST(coalesce(min(retry_at_ms) FILTER (waits AND error <> ''), 0) AS BIGINT) AS retry_at_ms, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS unresolved FROM (SELECT *, processed_revision <> revision OR generation <> 2 AS waits FROM scopes)""")
_add("eligible_scopes", lambda s, d: relational.eligible(_scopes(s, d), 2, 10_000), _SCOPES_SQL + " SELECT * FROM scopes WHERE (processed_revision <> revision OR generation <> 2) AND retry_at_ms <= 10000 ORDER BY revision, scope LIMIT 32")
_add("keyset_page", lambda s, d: relational.keyset_page(ledger.table(s, d, "orders").select("o_custkey", "o_orderkey"), ("o_custkey", "o_orderkey"), (20, 500), 50), "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 20 OR (o_custkey = 20 AND o_orderkey > 500) ORDER BY 1, 2 LIMIT 50")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes by order as they are stored, and later ones: those of even orders replace stored ones, the others are of evidence that
    comes anew."""
    o = ledger.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("scope"), F.col("o_orderstatus").alias("disposition"))
    anew = F.when(F.col("evidence_id") % 2 == 0, F.col("evidence_id")).otherwise(-F.col("evidence_id"))
    return o, o.withColumns({"evidence_id": anew, "disposition": F.lit("processed")})


_STORED_SQL = """WITH stored AS (SELECT o_orderkey AS evidence_id, o_custkey AS scope, o_orderstatus AS disposition FROM orders), later AS (SELECT CASE WHEN evidence_id % 2 = 0 THEN evidence_id ELSE -evidence_id END AS evidence_id, scope, 'processed' AS disposition FROM stored)"""
_add("upsert_outcomes", lambda s, d: relational.upsert(*_stored(s, d), ["evidence_id"]), _STORED_SQL + " SELECT * FROM stored WHERE evidence_id NOT IN (SELECT evidence_id FROM later) UNION ALL SELECT * FROM later")
_add("insert_ignore", lambda s, d: relational.insert_ignore(*_stored(s, d), ["evidence_id"], ["scope"]), _STORED_SQL + " SELECT * FROM stored UNION ALL SELECT * FROM later WHERE evidence_id NOT IN (SELECT evidence_id FROM stored)")
_add("replace_scopes", lambda s, d: relational.replace_scopes(*(x := _stored(s, d)), x[1].where("scope % 5 = 0")), _STORED_SQL + " SELECT * FROM stored WHERE scope NOT IN (SELECT scope FROM later WHERE scope % 5 = 0) UNION ALL SELECT * FROM later")


def _receipt(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    items = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"), F.col("l_orderkey").alias("evidence_id"))
    orders = ledger.table(spark, sf_dir, "orders")
    evidence = orders.select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("scope"))
    scopes = ledger.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"), F.col("c_nationkey").cast("long").alias("revision"))
    # A quarter of the outcomes is of a revision that no scope has: their evidence waits.
    revision = F.when(F.col("o_orderkey") % 4 == 1, -1).otherwise(F.col("o_custkey") % 25)
    outcomes = orders.select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderstatus").alias("disposition"), F.col("o_orderpriority").alias("code"), revision.alias("revision"))
    return relational.receipt(items, evidence, scopes, outcomes)


_add("receipt_join", lambda s, d: _receipt(s, d, ledger.table(s, d, "lineitem")), """WITH j AS (SELECT l_orderkey * 10 + l_linenumber AS sequence, l_orderkey AS evidence_id, o_custkey AS scope, CASE WHEN l_orderkey % 4 <> 1 AND o_custkey % 25 = c_nationkey THEN 1 ELSE 0 END AS current, o_orderstatus, o_orderpriority
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT sequence, evidence_id, scope, CASE current WHEN 1 THEN o_orderstatus ELSE 'pending' END AS disposition, CASE current WHEN 1 THEN o_orderpriority ELSE '' END AS code FROM j""")
_add("provenance_set", lambda s, d: relational.provenance(ledger.table(s, d, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_suppkey").alias("evidence_id"))), "SELECT DISTINCT l_orderkey AS fact_id, l_suppkey AS evidence_id FROM lineitem")


def _location_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions in directories of five kinds, nations as projects."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    kinds = [F.concat(F.lit("/home/u"), (k % 7).cast("string"), F.lit("/src//n"), n.cast("string"), F.lit("/./x/..")), F.concat(F.lit("C:\\Users\\u3\\n"), n.cast("string")), F.concat(F.lit("relative/n"), n.cast("string")), F.concat(F.lit(" /srv/n"), n.cast("string"), F.lit("/")), F.lit("")]
    directory = kinds[4]
    for i in range(4):
        directory = F.when(k % 5 == i, kinds[i]).otherwise(directory)
    customers = ledger.table(spark, sf_dir, "customer")
    sessions = customers.select(k.alias("id"), directory.alias("directory"), F.concat(F.lit("p"), n.cast("string")).alias("project_id"))
    projects = ledger.table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("id"), F.when(F.col("n_regionkey") == 2, "svn").otherwise("git").alias("vcs"))
    found = session_locations(customers.select(k.alias("session_native_id")), sessions, projects)
    return found.groupBy("directory_key", "directory_name", "repository_key", "repository_name", "repository_source").agg(F.count("*").alias("sessions"))


_add("location_join", _location_join, """WITH c AS (SELECT c_custkey % 5 AS kind, c_nationkey AS n, c_custkey % 7 AS u, n_regionkey <> 2 AS tracked FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT *, CASE kind WHEN 0 THEN '/home/u' || u || '/src/n' || n WHEN 1 THEN 'C:/Users/u3/n' || n WHEN 3 THEN '/srv/n' || n END AS path, CASE WHEN kind IN (0, 1, 3) THEN 'n' || n ELSE '' END AS directory_name FROM c)
SELECT coalesce(sha256('directory:' || path), '') AS directory_key, directory_name, CASE WHEN tracked THEN sha256('opencode-project:p' || n) ELSE '' END AS repository_key,
CASE WHEN NOT tracked THEN '' WHEN path IS NULL THEN 'unknown' ELSE 'n' || n END AS repository_name, CASE WHEN tracked THEN 'opencode-project' ELSE '' END AS repository_source, count(*) AS sessions FROM p GROUP BY ALL""")


# Graphs ---------------------------------------------------------------------------------------------------------------
def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as scopes; each has a parent but for those divisible by 7, and 3 and 4 point back at 6 and 8: a cycle each."""
    users = ledger.table(spark, sf_dir, "events").select(F.col("user_id").alias("node")).distinct()
    up = users.where("node % 7 <> 0").select(F.col("node").alias("child"), F.expr("node div 2").alias("parent"))
    return users, up.unionByName(spark.createDataFrame([(3, 6), (4, 8)], "child long, parent long"))


_EDGES_SQL = "WITH RECURSIVE users AS (SELECT DISTINCT user_id AS node FROM events), edges AS (SELECT node AS child, node // 2 AS parent FROM users WHERE node % 7 <> 0 UNION ALL VALUES (3, 6), (4, 8))"
_add("component_labels", lambda s, d: graph.component_labels(*_edges(s, d)), _EDGES_SQL + """, both_ways AS (SELECT child AS a, parent AS b FROM edges UNION SELECT parent, child FROM edges), nodes AS (SELECT node FROM users UNION SELECT a FROM both_ways),
reach AS (SELECT node, node AS seen FROM nodes UNION SELECT reach.node, b FROM reach JOIN both_ways ON a = seen) SELECT node, min(seen) AS component FROM reach GROUP BY node""")
_add("descendants", lambda s, d: graph.descendants((x := _edges(s, d))[1], x[0].where("node IN (3, 5, 9)")), _EDGES_SQL + ", below AS (SELECT node FROM users WHERE node IN (3, 5, 9) UNION SELECT child FROM below JOIN edges ON parent = node) SELECT node FROM below")


# Order-dependent operators --------------------------------------------------------------------------------------------
def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))


_TURNS_SQL = "WITH t AS (SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS size FROM conversations)"
_add(
    "last_context",
    lambda s, d: context.carried(_turns(s, d), {"user": F.col("role") == "user", "assistant": F.col("role") == "assistant"}, F.col("size"), ("conv_id",), "turn"),
    _TURNS_SQL + """ SELECT *, last_value(CASE role WHEN 'user' THEN size END IGNORE NULLS) OVER w AS last_user, last_value(CASE role WHEN 'assistant' THEN size END IGNORE NULLS) OVER w AS last_assistant FROM t
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
_add(
    "asof_next_context",
    lambda s, d: context.next_value(_turns(s, d), F.col("role") == "user", F.col("turn"), "next_user", ("conv_id",), "turn"),
    _TURNS_SQL + " SELECT *, first_value(CASE role WHEN 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_user FROM t",
)


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.facts(spark, sf_dir).select("session_native_id", "event_id", "model")
    found = context.distinct_over(rows, "session_native_id", "event_id", "model", 5, "models")
    return found.withColumn("models", F.array_join("models", ","))


_add("sliding_distinct", _sliding, ledger.FACTS_SQL + """ SELECT session_native_id, event_id, array_to_string(list_sort(list_distinct(list(model) OVER (PARTITION BY session_native_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))), ',') AS models FROM facts""")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ordinal"), k.alias("cumulative"), F.expr("event_id div 40").alias("turn"), (F.col("user_id") % 2 == 0).alias("is_fork"))


_SNAPSHOTS_SQL = """WITH s AS (SELECT user_id AS session_id, event_id AS ordinal, CAST(json_extract_string(props, '$.k') AS BIGINT) AS cumulative, event_id // 40 AS turn, user_id % 2 = 0 AS is_fork FROM events)"""
_add(
    "cumulative_highwater",
    lambda s, d: context.high_water(_snapshots(s, d), order=("ordinal",)),
    _SNAPSHOTS_SQL + """, m AS (SELECT *, max(cumulative) OVER (PARTITION BY session_id, CASE WHEN is_fork THEN turn ELSE 0 END ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM s)
SELECT session_id, ordinal, cumulative, turn, is_fork, CASE WHEN cumulative = mark THEN 'known_duplicate' WHEN cumulative < mark THEN 'stale_snapshot' ELSE '' END AS code FROM m""",
)
_add(
    "first_seen",
    lambda s, d: context.first_seen(_snapshots(s, d).select("session_id", "ordinal", "cumulative"), "cumulative", ("session_id",), ("ordinal",)),
    _SNAPSHOTS_SQL + " SELECT session_id, ordinal, cumulative, ordinal = min(ordinal) OVER (PARTITION BY session_id, cumulative) AS is_first FROM s",
)


# Interpretation -------------------------------------------------------------------------------------------------------
def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    harness = F.when(e % 3 == 0, "claude-code").when(e % 3 == 1, "opencode").otherwise("pi")
    return ledger.table(spark, sf_dir, "events").select(
        F.concat(F.lit("f-"), F.col("user_id").cast("string"), F.lit("-"), (e % 60).cast("string")).alias("fact_id"), harness.alias("harness"),
        F.when(harness == "opencode", F.when(e % 2 == 0, "opencode-v2").otherwise("opencode-v1")).otherwise("jsonl").alias("format"), F.expr("event_id div 100").alias("occurred_at_ms"),
        F.lpad(e.cast("string"), 9, "0").alias("evidence_id"), F.when(F.col("user_id") % 2 == 0, "req").otherwise("").alias("request_id"), (F.floor("value") % 2).cast("string").alias("payload_hash"),
        F.when(e % 17 == 0, "known_duplicate").when(e % 19 == 0, "stale_snapshot").when(e % 23 == 0, "missing_parent").otherwise("").alias("code"),
    )


_RESOLVED_SQL = """WITH c AS (SELECT 'f-' || user_id || '-' || (event_id % 60) AS fact_id, CASE event_id % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'opencode' ELSE 'pi' END AS harness,
  CASE WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'opencode-v2' ELSE 'opencode-v1' END ELSE 'jsonl' END AS format, event_id // 100 AS occurred_at_ms,
  lpad(CAST(event_id AS VARCHAR), 9, '0') AS evidence_id, CASE WHEN user_id % 2 = 0 THEN 'req' ELSE '' END AS request_id, CAST(CAST(floor(value) AS BIGINT) % 2 AS VARCHAR) AS payload_hash,
  CASE WHEN event_id % 17 = 0 THEN 'known_duplicate' WHEN event_id % 19 = 0 THEN 'stale_snapshot' WHEN event_id % 23 = 0 THEN 'missing_parent' ELSE '' END AS code FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY format = 'opencode-v2' DESC, format <> 'opencode-v2' AND code = '' DESC, occurred_at_ms DESC, evidence_id DESC) AS place FROM c),
j AS (SELECT n.*, s.payload_hash AS s_hash, s.format AS s_format, s.harness AS s_harness, s.request_id AS s_request, s.occurred_at_ms AS s_ms FROM n JOIN (SELECT * FROM n WHERE place = 1) s USING (fact_id)),
f AS (SELECT *, bool_or(code = '' AND payload_hash <> s_hash AND NOT (s_format = 'opencode-v2' AND format = 'opencode-v1') AND NOT (s_harness = 'claude-code' AND s_request <> '' AND occurred_at_ms <> s_ms)) OVER (PARTITION BY fact_id) AS conflict FROM j),
resolved AS (SELECT fact_id, harness, format, occurred_at_ms, evidence_id, request_id, payload_hash, code, conflict, place = 1 AS is_selected,
  CASE WHEN conflict THEN 'ambiguous' WHEN code = 'known_duplicate' THEN 'duplicate' WHEN code = 'stale_snapshot' THEN 'superseded' WHEN code <> '' THEN 'ambiguous' WHEN place = 1 THEN 'processed'
    WHEN occurred_at_ms < s_ms OR format <> s_format THEN 'superseded' ELSE 'duplicate' END AS disposition,
  CASE WHEN conflict THEN 'conflicting_native_identity' WHEN code IN ('known_duplicate', 'stale_snapshot') THEN '' ELSE code END AS outcome_code FROM f)"""
_add("resolve_groups", lambda s, d: resolve.resolve(_candidates(s, d)), _RESOLVED_SQL + " SELECT * FROM resolved")
_add("outcome_counts", lambda s, d: resolve.resolve(_candidates(s, d)).groupBy("disposition", "outcome_code").agg(F.count("*").alias("n")), _RESOLVED_SQL + " SELECT disposition, outcome_code, count(*) AS n FROM resolved GROUP BY ALL")
_add("resolved_contributions", lambda s, d: resolve.contributions(resolve.resolve(_candidates(s, d))).select("fact_id", "evidence_id"), _RESOLVED_SQL + " SELECT fact_id, evidence_id FROM resolved WHERE is_selected AND NOT conflict AND code = ''")
_add("resolved_estimates", lambda s, d: resolve.estimates(resolve.resolve(_candidates(s, d))).select("fact_id", "evidence_id", "reason_code"), _RESOLVED_SQL + """ SELECT fact_id, evidence_id, CASE WHEN conflict THEN 'conflicting_native_identity' ELSE code END AS reason_code FROM resolved
WHERE is_selected AND (conflict OR code NOT IN ('', 'known_duplicate', 'stale_snapshot'))""")
_add("resolved_provenance", lambda s, d: resolve.provenance(resolve.resolve(_candidates(s, d))), _RESOLVED_SQL + " SELECT DISTINCT fact_id, evidence_id FROM resolved WHERE fact_id IN (SELECT fact_id FROM resolved WHERE is_selected AND NOT conflict AND code = '')")


# Functions ------------------------------------------------------------------------------------------------------------
_add(
    "safe_metadata",
    lambda s, d: ledger.table(s, d, "pages").select("page_id", text.safe_metadata(F.col("url")).alias("url_is_safe"), text.safe_metadata(F.regexp_extract("url", "://([^/]*)", 1)).alias("host_is_safe"), F.octet_length("html").cast("long").alias("octets")),
    r"""SELECT page_id, coalesce(strlen(url) <= 256 AND NOT regexp_matches(url, '^/|\\|://|@|^.:/|[\x00-\x1F\x7F-\x9F]'), false) AS url_is_safe,
coalesce(strlen(regexp_extract(url, '://([^/]*)', 1)) <= 256 AND NOT regexp_matches(regexp_extract(url, '://([^/]*)', 1), '^/|\\|://|@|^.:/|[\x00-\x1F\x7F-\x9F]'), false) AS host_is_safe, CAST(strlen(html) AS BIGINT) AS octets FROM pages""",
)
_add(
    "remote_identity",
    lambda s, d: ledger.table(s, d, "pages").select("page_id", location.remote_identity(F.regexp_replace("url", "[?#].*$", "")).alias("identity")),
    r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(u, '^https?://([^/:]+)', 1)) || '/' || regexp_extract(u, '^https?://[^/]+/+(.+)$', 1), '/+$', ''), '\.git$', '') AS identity FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)""",
)
_add("location_label", lambda s, d: ledger.table(s, d, "documents").select("doc_id", text.location_label(F.col("text")).alias("label")), r"""SELECT doc_id, CASE WHEN t IN ('', '.') THEN 'unknown' ELSE t END AS label FROM (SELECT doc_id, substr(trim(regexp_replace(text, '[\x00-\x1F\x7F-\x9F]', '', 'g')), 1, 48) AS t FROM documents)""")
_add("fact_identity", lambda s, d: ledger.facts(s, d).select("event_id", text.tuple_hash("fact-v1", "default", F.col("harness"), F.col("session_native_id"), F.col("message_native_id"), "", "message").alias("fact_id")), ledger.FACTS_SQL + """ SELECT event_id, sha256('["fact-v1","default","' || harness || '","' || session_native_id || '","' || message_native_id || '","","message"]') AS fact_id FROM facts""")
_add("token_sums", lambda s, d: ledger.facts(s, d).groupBy("harness").agg(F.sum(text.token_sum(F.col("input_tokens"), F.col("output_tokens"), F.when(F.col("reasoning_tokens") > 0, F.col("reasoning_tokens")))).alias("n")), ledger.FACTS_SQL + " SELECT harness, CAST(sum(input_tokens + output_tokens + reasoning_tokens) AS BIGINT) AS n FROM facts GROUP BY harness")
_add("compact_counts", lambda s, d: ledger.table(s, d, "orders").select("o_orderkey", text.compact_count(F.floor("o_totalprice")).alias("shown")), """SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE CAST(t // 10 AS VARCHAR) || CASE WHEN t % 10 = 0 THEN '' ELSE '.' || CAST(t % 10 AS VARCHAR) END || CASE WHEN n < 1000000 THEN 'K' ELSE 'M' END END AS shown
FROM (SELECT *, CASE WHEN n < 1000000 THEN (n + 50) // 100 ELSE (n + 50000) // 100000 END AS t FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders))""")
_add("exact_counts", lambda s, d: ledger.table(s, d, "orders").select("o_orderkey", text.exact_count(F.floor("o_totalprice")).alias("shown")), "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS shown FROM orders")
_add("chart_labels", lambda s, d: ledger.table(s, d, "part").select("p_partkey", text.chart_label(F.col("p_name")).alias("label")), "SELECT p_partkey, CASE WHEN length(p_name) > 17 THEN substr(p_name, 1, 15) || '…' ELSE p_name END AS label FROM part")
_add("calendar_buckets", lambda s, d: ledger.facts(s, d).select("event_id", *(calendar.bucket("occurred_at_ms", "America/New_York", u).alias(u) for u in calendar.UNITS)), ledger.FACTS_SQL + f" SELECT event_id, {', '.join(f'{_sql_bucket("America/New_York", u)} AS {u}' for u in calendar.UNITS)} FROM facts")
_add("plain_counts", lambda s, d: ledger.table(s, d, "orders").select("o_orderkey", text.plain_count((F.floor("o_totalprice") * (F.col("o_orderkey") % 40 - 3)).cast("bigint")).alias("tokens"), text.plain_context(F.floor("o_totalprice") * (F.col("o_orderkey") % 40)).alias("context")), """WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40 - 3) AS n, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40) AS c FROM orders)
SELECT o_orderkey, CASE WHEN n = 0 THEN '' WHEN abs(n) < 1000 THEN CAST(n AS VARCHAR) WHEN abs(n) < 1000000 THEN CAST(sign(n) * (abs(n) // 1000) AS BIGINT) || 'K' ELSE CAST(sign(n) * (abs(n) // 1000000) AS BIGINT) || 'M' END AS tokens,
CASE WHEN c = 0 THEN '' WHEN c < 1000 THEN CAST(c AS VARCHAR) WHEN c < 1000000 THEN (c + 999) // 1000 || 'k' ELSE c // 1000000 || 'M' END AS context FROM n""")
_add("server_dates", lambda s, d: ledger.facts(s, d).select("event_id", calendar.server_date("occurred_at_ms", "Australia/Sydney").alias("day"), calendar.server_date("occurred_at_ms", "Australia/Sydney", True).alias("minute")), ledger.FACTS_SQL + """ SELECT event_id, strftime(t, '%b %-d, %Y') AS day, strftime(t, '%b %-d, %Y, %H:%M') AS minute FROM (SELECT event_id, timezone('Australia/Sydney', make_timestamptz(occurred_at_ms * 1000)) AS t FROM facts)""")
_add("client_order", lambda s, d: dashboard.client_ordered(dashboard.grouped(ledger.facts(s, d), _MODELS, UTC), "models", "sessions"), f"{ledger.FACTS_SQL}, grouped AS ({_sql_rows(_MODELS, UTC)}) SELECT * FROM grouped ORDER BY sessions DESC, total DESC, name")
_add("visible_total", lambda s, d: dashboard.visible_total(dashboard.page(ledger.facts(s, d), _MODELS, UTC)), f"{ledger.FACTS_SQL}, grouped AS ({_sql_rows(_MODELS, UTC)}) SELECT CAST(sum(total) AS BIGINT) AS total FROM (SELECT total FROM grouped ORDER BY total DESC, key LIMIT {_MODELS.page_size})")
_add("merged_lists", lambda s, d: ledger.facts(s, d).groupBy("harness").agg(F.collect_set("provider").alias("a"), F.collect_set("model").alias("b")).select("harness", F.array_join(text.merged(F.col("a"), F.col("b")), ",").alias("names")), ledger.FACTS_SQL + " SELECT harness, string_agg(n, ',' ORDER BY n) AS names FROM (SELECT harness, provider AS n FROM facts UNION SELECT harness, model FROM facts) GROUP BY harness")
_add("filter_options", lambda s, d: relational.filter_options(dashboard.facet(ledger.facts(s, d), _FACET_QUERY, UTC, "models"), ["model-1", "Gone-1", ""], "", "O"), ledger.FACTS_SQL + f", o AS (SELECT DISTINCT model AS key, model AS name FROM {_sql_where(replace(_FACET_QUERY, selection=replace(_FACET_QUERY.selection, models=())), UTC)}) SELECT * FROM o WHERE contains(lower(name), 'o') UNION ALL SELECT * FROM (VALUES ('Gone-1', 'Gone-1'), ('', 'unknown')) v(key, name) WHERE key NOT IN (SELECT key FROM o)")
_add("unresolved_records", lambda s, d: relational.unresolved(native.projection(s, d).outcomes), f"{native.SQL} SELECT count(*) AS unresolved FROM native WHERE code = 'unusable'")


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = _scopes(spark, sf_dir).withColumn("attempts", F.col("revision") % 9)
    return relational.failed(scopes, scopes.where("revision % 2 = 0"), "broken_again", 1000)


_add("failed_scopes", _failures, _SCOPES_SQL + """, s AS (SELECT *, revision % 9 AS attempts, revision % 2 = 0 AS hit FROM scopes)
SELECT scope, revision, processed_revision, generation, CASE WHEN hit THEN 'broken_again' ELSE error END AS error, CASE WHEN hit THEN 1000 + 1000 * CAST(2 ** least(attempts, 6) AS BIGINT) ELSE retry_at_ms END AS retry_at_ms, attempts + CASE WHEN hit THEN 1 ELSE 0 END AS attempts FROM s""")
_add("options_with_selected", lambda s, d: relational.options_with_selected(dashboard.facet(ledger.facts(s, d), _FACET_QUERY, UTC, "models"), ["model-1", "gone", ""]), ledger.FACTS_SQL + f", o AS (SELECT DISTINCT model AS key, model AS name FROM {_sql_where(replace(_FACET_QUERY, selection=replace(_FACET_QUERY.selection, models=())), UTC)}) SELECT * FROM o UNION ALL SELECT * FROM (VALUES ('gone', 'gone'), ('', 'unknown')) v(key, name) WHERE key NOT IN (SELECT key FROM o)")


# From native records to facts -----------------------------------------------------------------------------------------
_NATIVE = ", ".join(native.COLUMNS)
_add("native_facts", lambda s, d: native.projection(s, d).facts.select(*native.COLUMNS), f"{native.SQL} SELECT {_NATIVE} FROM native WHERE code = ''")
_add("native_estimates", lambda s, d: native.projection(s, d).estimates.select(*native.COLUMNS, "reason_code"), f"{native.SQL} SELECT {_NATIVE}, code AS reason_code FROM native WHERE code NOT IN ('', 'unusable')")
_add("native_outcomes", lambda s, d: native.projection(s, d).outcomes.groupBy("disposition", "code").agg(F.count("*").alias("n")), f"""{native.SQL}
SELECT CASE code WHEN '' THEN 'processed' ELSE 'ambiguous' END AS disposition, CASE code WHEN 'unusable' THEN 'unusable_usage' ELSE code END AS code, count(*) AS n FROM native GROUP BY ALL""")
_NATIVE_QUERY = normalize(Query("providers", ALL))
_add("native_dashboard", lambda s, d: dashboard.page(native.projection(s, d).facts, _NATIVE_QUERY, UTC), f"{native.SQL}, facts AS (SELECT *, '' AS directory_name, '' AS repository_name FROM native WHERE code = ''), grouped AS ({_sql_rows(_NATIVE_QUERY, UTC)}) SELECT * FROM grouped ORDER BY total DESC, key ASC LIMIT {_NATIVE_QUERY.page_size}")
_add("usage_records", lambda s, d: native.evidence(s, d).groupBy("harness").agg(F.count_if("is_usage").alias("n"), F.count("*").alias("records")), f"{native.SQL} SELECT harness, count(*) AS n, count(*) AS records FROM native GROUP BY harness")
_add("admission_rounds", lambda s, d: delivery.admitted(ledger.table(s, d, "events"), "user_id", F.octet_length("props"), 2_000, 8), """WITH RECURSIVE c AS (SELECT user_id AS component, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY user_id),
p AS (SELECT *, CAST(component % 8 AS VARCHAR) AS worker, row_number() OVER (PARTITION BY component % 8 ORDER BY component) AS n FROM c),
b AS (SELECT component, bytes, worker, n, CAST(0 AS BIGINT) AS round, bytes AS held FROM p WHERE n = 1
UNION ALL SELECT p.component, p.bytes, p.worker, p.n, CASE WHEN held + p.bytes > 2000 THEN round + 1 ELSE round END, CASE WHEN held + p.bytes > 2000 THEN p.bytes ELSE held + p.bytes END FROM b JOIN p ON p.worker = b.worker AND p.n = b.n + 1)
SELECT component, bytes, worker, round FROM b""")
_add("fork_scopes", native.fork_scopes, native.FORK_SCOPES_SQL)
_add("outbox_numbers", lambda s, d: outbox.numbered(ledger.table(s, d, "orders").select("o_custkey", "o_orderkey"), ("o_custkey", "o_orderkey"), 100), "SELECT o_custkey, o_orderkey, 100 + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS sequence FROM orders")
_add("fork_decisions", native.fork_decisions, native.FORKS_SQL)
_add("fork_codes", lambda s, d: native.fork_decisions(s, d).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct(F.unhex("fact_id")).alias("facts")), f"SELECT code, count(*) AS n, count(DISTINCT fact_id) AS facts FROM ({native.FORKS_SQL}) GROUP BY code")
_add("batch_bytes", lambda s, d: delivery.batched(ledger.table(s, d, "pages"), F.expr("page_id div 100"), "page_id", F.octet_length("html"), 20, 100_000), """WITH RECURSIVE p AS (SELECT CAST(page_id // 100 AS VARCHAR) AS queue, page_id AS sequence, strlen(html) AS size, row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) AS n FROM pages),
b AS (SELECT queue, sequence, n, CAST(0 AS BIGINT) AS batch, 1 AS held, size AS bytes FROM p WHERE n = 1
UNION ALL SELECT p.queue, p.sequence, p.n, CASE WHEN held = 20 OR bytes + p.size > 100000 THEN batch + 1 ELSE batch END, CASE WHEN held = 20 OR bytes + p.size > 100000 THEN 1 ELSE held + 1 END, CASE WHEN held = 20 OR bytes + p.size > 100000 THEN p.size ELSE bytes + p.size END FROM b JOIN p ON p.queue = b.queue AND p.n = b.n + 1)
SELECT queue, sequence, batch FROM b""")


# Progress of collectors -----------------------------------------------------------------------------------------------
def _progress_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as attempts, 32 to an instance: the first event begins one, the others are heartbeats, 20 ms for each event."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    text = lambda value: F.lit(value).cast("string")
    messages = ledger.table(spark, sf_dir, "events").select(
        F.concat(F.lit("i"), F.expr("user_id div 32").cast("string")).alias("instance_id"), (F.col("event_id") * 20).alias("received_at_ms"), F.col("event_id").alias("position"), F.when(first, "begin").otherwise("heartbeat").alias("operation"),
        F.md5(F.col("user_id").cast("string")).alias("attempt_id"), text(None).alias("stage"), F.lit(None).cast("map<string,string>").alias("harnesses"), *(F.lit(None).cast("bigint").alias(c) for c in ("acknowledged_batches", "acknowledged_entries", "pending")), text(None).alias("error_code"),
    )
    return progress.follow(messages).where("answer <> ''").select("instance_id", "attempt_id", "position", "cause", "answer")


_add("progress_answers", _progress_answers, f"""WITH m AS (SELECT event_id, user_id, event_id * 20 AS ms, row_number() OVER w AS n, event_id * 20 - lag(event_id * 20) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT *, coalesce(bool_or(gap >= {progress.LEASE_MS}) OVER (PARTITION BY user_id ORDER BY event_id), false) AS lost FROM m), e AS (SELECT *, max(ms) FILTER (NOT lost) OVER (PARTITION BY user_id) + {progress.LEASE_MS} AS expiry FROM l)
SELECT 'i' || user_id // 32 AS instance_id, md5(CAST(user_id AS VARCHAR)) AS attempt_id, event_id AS position, CASE n WHEN 1 THEN 'begin' ELSE 'heartbeat' END AS cause,
CASE WHEN NOT lost THEN 'accepted' WHEN ms - expiry < {progress.RETENTION_MS} THEN 'conflict' ELSE 'missing' END AS answer FROM e""")


def _progress_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of users' attempts, with leases of half a day; attempts that ended are kept for two days."""
    e, at = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    stage = F.element_at(F.array(*map(F.lit, progress.STAGES)), (e % 6 + 1).cast("int"))
    log = ledger.table(spark, sf_dir, "events").select(
        F.concat(F.lit("i"), (F.col("user_id") % 20).cast("string")).alias("instance_id"), F.col("user_id").cast("string").alias("attempt_id"), at.alias("at_ms"), F.lit("update").alias("cause"), F.lit("accepted").alias("answer"), stage.alias("stage"),
        F.lit(None).cast("map<string,string>").alias("harnesses"), e.alias("acknowledged_batches"), e.alias("acknowledged_entries"), F.lit(None).cast("bigint").alias("pending"), F.when(stage == "failed", "submission_failed").when(stage == "interrupted", "cancelled").otherwise("").alias("error_code"),
        F.lit(0).cast("bigint").alias("started_at_ms"), at.alias("updated_at_ms"), (at + 43_200_000).alias("expires_at_ms"), F.when(stage.isin(*progress.ENDED), at).otherwise(0).alias("finished_at_ms"), e.alias("revision"),
    )
    found = progress.visible(progress.snapshot(log, NOW, 172_800_000))
    return found.select("instance_id", "attempt_id", "stage", "label", "error_code", "acknowledged_batches", "updated_at_ms", "finished_at_ms")


_add("progress_visible", _progress_visible, f"""WITH a AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, ['waiting', 'capturing', 'submitting', 'accepted', 'failed', 'interrupted'][event_id % 6 + 1] AS said FROM events WHERE epoch_us(ts) // 1000 <= {NOW} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
b AS (SELECT *, event_id % 6 < 3 AS open, event_id % 6 < 3 AND ms + 43200000 <= {NOW} AS lost FROM a), c AS (SELECT 'i' || user_id % 20 AS instance_id, CAST(user_id AS VARCHAR) AS attempt_id, CASE WHEN lost THEN 'interrupted' ELSE said END AS stage,
  CASE WHEN lost THEN 'publisher_lost' WHEN said = 'failed' THEN 'submission_failed' WHEN said = 'interrupted' THEN 'cancelled' ELSE '' END AS error_code, event_id AS acknowledged_batches, CASE WHEN lost THEN ms + 43200000 ELSE ms END AS updated_at_ms,
  CASE WHEN lost THEN ms + 43200000 WHEN open THEN 0 ELSE ms END AS finished_at_ms, open AND NOT lost AS active FROM b), d AS (SELECT * FROM c WHERE active OR finished_at_ms + 172800000 > {NOW})
SELECT instance_id, attempt_id, stage, CASE WHEN error_code = 'submission_failed' THEN 'Submission failed' ELSE CASE stage WHEN 'waiting' THEN 'Waiting to collect' WHEN 'capturing' THEN 'Collecting usage' WHEN 'submitting' THEN 'Submitting usage' WHEN 'accepted' THEN 'Usage accepted'
  WHEN 'failed' THEN 'Collection failed' ELSE 'Collection interrupted' END END AS label, error_code, acknowledged_batches, updated_at_ms, finished_at_ms FROM d QUALIFY active OR row_number() OVER (PARTITION BY instance_id, active ORDER BY updated_at_ms DESC, attempt_id DESC) = 1""")
