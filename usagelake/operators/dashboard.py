"""Dashboard queries over facts: filters, groups, pages, charts, summaries and facets.

Facts come as a DataFrame of one dataset's active generation (see operators.generations). Everything is one declarative
plan: filters reach the scan, only the columns that a tab needs are read, and one aggregation makes a tab's groups.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import bucket
from ..functions.text import ascii_lower, or_unknown
from ..plans.query import CHART_ROWS, FACET_ROWS, MOST_ROWS, SESSION_ROWS, SORT_COLUMNS, TIMELINE_ROWS, Query, instants, normalize
from ..schemas import SAFE_INTEGER
from .facts import in_days

COUNTS = ("input", "output", "reasoning", "cache_read", "cache_write", "total")
NUMBERS = ("sessions", *COUNTS, "context", "average_context", "median_context", "max_context")
ROW = ("key", "name", "harness", "provider", "model", "date", *NUMBERS, "location_key", "location_name", "directory_names", "unknown_directory", "repository_key", "repository_name")
FACETS = {"providers": "provider", "models": "model", "harnesses": "harness", "sessions": "session_native_id", "repositories": "repository_key", "directories": "directory_key"}


class TooManyRows(ValueError):
    """A complete read would have more rows than it was allowed."""


@dataclass(frozen=True)
class Clock:
    """The instant and zone that periods and buckets are local to."""

    now_ms: int
    zone: str = "UTC"


def filtered(facts: DataFrame, q: Query, clock: Clock) -> DataFrame:
    """Countable facts in the query's range with its dimensions. Location filters hold on the repo tab only. A table with a day
    column is read in the range's days only."""
    out = facts.where("countable")
    start, end = instants(q.selection, clock.now_ms, clock.zone)
    if "day" in facts.columns:
        out = in_days(out, start, end)
    if start is not None:
        out = out.where(F.col("occurred_at_ms") >= start)
    if end is not None:
        out = out.where(F.col("occurred_at_ms") < end)
    s = q.selection
    wanted = [("provider", s.providers), ("model", s.models), ("harness", s.harnesses), ("session_native_id", s.sessions)]
    for column, values in wanted:
        if values:
            out = out.where(F.col(column).isin(*values))
    if q.tab == "repo":
        for column, values in (("repository_key", q.repositories), ("directory_key", q.directories)):
            if values:
                out = out.where(or_unknown(column).isin(*values))
    return out


def guarded(value: Column) -> Column:
    """The value, or the error aggregate_limit outside 0 to 2^53 - 1."""
    return F.when((value < 0) | (value > SAFE_INTEGER), F.raise_error("aggregate_limit").cast("bigint")).otherwise(value)


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def _sums() -> list[Column]:
    return [guarded(_sum(f"{c}_tokens")).alias(c) for c in COUNTS]


def _names(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def _sessions() -> Column:
    """A session's id follows from these two, which need no hashing."""
    return guarded(F.countDistinct("harness", "session_native_id"))


def _load() -> Column:
    return F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")


def group_columns(q: Query, clock: Clock) -> dict[str, Column]:
    """What makes a row of the tab, by name."""
    plain = {"providers": ("provider",), "harnesses": ("harness",), "models": ("model",), "sessions": ("harness", "session_native_id"), "context": ("harness", "provider", "model")}
    if q.tab == "tokens":
        return {"bucket": bucket("occurred_at_ms", clock.zone, q.selection.bucket)}
    if q.tab == "repo":
        return {"location": or_unknown(f"{q.location_group}_key")}
    return {c: F.col(c) for c in plain[q.tab]}


def group_count(facts: DataFrame, q: Query, clock: Clock) -> DataFrame:
    """One row, n_groups: how many rows the tab has, without its aggregates."""
    by = [c.alias(f"g_{n}") for n, c in group_columns(q, clock).items()]
    return filtered(facts, q, clock).select(*by).distinct().agg(F.count("*").alias("n_groups"))


def grouped(facts: DataFrame, q: Query, clock: Clock) -> DataFrame:
    """All rows of the tab, unordered, with the columns of ROW."""
    rows = filtered(facts, q, clock)
    if q.tab == "context":
        return _context(rows)
    by = group_columns(q, clock)
    keyed = rows.withColumns({f"g_{n}": c for n, c in by.items()})
    repo = q.tab == "repo"
    only = F.min("repository_key") == F.max("repository_key")
    where = [
        or_unknown(F.min(f"{q.location_group}_name")).alias("location_name"),
        F.to_json(F.array_sort(F.collect_set(F.when(F.col("directory_name") != "", F.col("directory_name"))))).alias("directory_names"),
        F.bool_or((F.col("directory_key") == "") | (F.col("directory_name") == "")).alias("unknown_directory"),
        F.when(only, F.min("repository_key")).otherwise("unknown").alias("repository_key"),
        F.when(only, F.min("repository_name")).otherwise("unknown").alias("repository_name"),
    ] if repo else [F.lit("").alias("location_name"), F.lit("[]").alias("directory_names"), F.lit(False).alias("unknown_directory"), F.lit("").alias("repository_key"), F.lit("").alias("repository_name")]
    # A dimension that rows are grouped by has one value in each, and a session's row has one session.
    own = lambda c: F.first(c).alias(c) if c in by else _names(c).alias(c)
    sessions = F.lit(1).cast("bigint") if q.tab == "sessions" else _sessions()
    out = keyed.groupBy(*(f"g_{n}" for n in by)).agg(
        *(own(c) for c in ("harness", "provider", "model")), F.max("occurred_at_ms").alias("date"), sessions.alias("sessions"),
        *_sums(), guarded(F.max(_load())).alias("context"), *(where if repo else []),
    )
    if not repo:
        out = out.select("*", *where)
    first = F.col("g_" + list(by)[-1])
    key = F.concat_ws(":", *(F.col(f"g_{n}") for n in by))
    zero = {c: F.lit(0).cast("bigint") for c in ("average_context", "median_context", "max_context")}
    named = {"key": key, "name": F.col("location_name") if repo else first, "location_key": key if repo else F.lit("")}
    return out.withColumns(zero | named).select(*ROW)


def _context(rows: DataFrame) -> DataFrame:
    """Each session's peak first, then mean, median and maximum of a model's peaks, rounded down. Sessions with equal peaks are
    counted before anything is ordered, so that a group's window has a row for each different peak only."""
    by = ("harness", "provider", "model")
    peaks = rows.groupBy(*by, "session_native_id").agg(F.max(_load()).alias("peak"), F.max("occurred_at_ms").alias("latest"))
    counted = peaks.groupBy(*by, "peak").agg(F.count("*").alias("n"), F.max("latest").alias("latest"))
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("peak").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select("*", upto.alias("upto"), F.sum("n").over(group).alias("size"))
    at = lambda place: F.min(F.when(F.col("upto") >= F.expr(place), F.col("peak")))
    out = ranked.groupBy(*by).agg(
        F.max("latest").alias("date"), F.sum("n").alias("sessions"), F.expr("sum(peak * n) div sum(n)").alias("average_context"),
        at("(size + 1) div 2").alias("low"), at("(size + 2) div 2").alias("high"), F.max("peak").alias("max_context"),
    ).withColumn("median_context", F.expr("low + (high - low) div 2"))
    empty = {c: F.lit("") for c in ("location_key", "location_name", "repository_key", "repository_name")} | {"directory_names": F.lit("[]"), "unknown_directory": F.lit(False)}
    zero = {c: F.lit(0).cast("bigint") for c in (*COUNTS, "context")}
    return out.withColumns({"key": F.concat_ws(":", *by), "name": F.col("model")} | zero | empty).withColumns({c: guarded(F.col(c)) for c in ("average_context", "median_context", "max_context")}).select(*ROW)


def ordered(rows: DataFrame, sort: str, direction: str) -> DataFrame:
    """By the sort's column, any other name being total; ties by key."""
    name = SORT_COLUMNS.get(sort, sort)
    column = F.col(name if name in ROW[1:18] else "total")
    return rows.orderBy(column.asc() if direction == "asc" else column.desc(), F.col("key").asc())


def client_ordered(rows: DataFrame, tab: str, sort: str) -> DataFrame:
    """A terminal's order of rows that it has: numbers and dates falling, texts rising; ties by falling total, then by name."""
    name = F.col("name")
    if sort == "name":
        return rows.orderBy(name)
    column = SORT_COLUMNS.get(sort, sort)
    if column in ("harness", "provider", "model"):
        first = F.col(column).asc()
    elif column == "date" and tab == "tokens":
        first = F.col("key").desc()  # the bucket
    else:
        first = F.col(column if column in ("date", *NUMBERS) else "total").desc()
    return rows.orderBy(first, F.col("total").desc(), name)


def visible_total(rows: DataFrame) -> DataFrame:
    """One row: all tokens of the rows shown."""
    return rows.agg(_sum("total").alias("total"))


def page(facts: DataFrame, q: Query, clock: Clock, n_groups: int | None = None) -> DataFrame:
    """The query's page. n_groups: if known, a page beyond the last one is the last one."""
    number = q.page if n_groups is None else min(q.page, max(1, -(-n_groups // q.page_size)))
    return ordered(grouped(facts, q, clock), q.sort, q.direction).offset((number - 1) * q.page_size).limit(q.page_size)


def chart(facts: DataFrame, q: Query, clock: Clock) -> DataFrame:
    """The largest rows; for tokens and sessions the earliest buckets of the token timeline."""
    if q.tab in ("tokens", "sessions"):
        return ordered(grouped(facts, replace(q, tab="tokens"), clock), "date", "asc").limit(TIMELINE_ROWS)
    return ordered(grouped(facts, q, clock), "averageContext" if q.tab == "context" else "total", "desc").limit(CHART_ROWS)


def summary(facts: DataFrame, q: Query, clock: Clock) -> DataFrame:
    """One row: sums, sessions and facts of the selection."""
    return filtered(facts, q, clock).agg(*_sums(), _sessions().alias("sessions"), F.count("*").alias("facts"))


def synced_sessions(facts: DataFrame) -> DataFrame:
    """One row: sessions of all countable facts, whatever the selection."""
    return facts.where("countable").agg(_sessions().alias("synced_sessions"))


def facet(facts: DataFrame, q: Query, clock: Clock, name: str, search: str = "") -> DataFrame:
    """(key, name) of a filter's options: all other filters hold, its own doesn't."""
    s, column = q.selection, FACETS[name]
    free = replace(q, selection=replace(s, **{name: ()})) if name in ("providers", "models", "harnesses", "sessions") else replace(q, **{name: ()})
    rows = filtered(facts, free, clock)
    if name in ("repositories", "directories"):
        labels = rows.groupBy(column).agg(F.min(column.replace("_key", "_name")).alias("label"))
        out = labels.select(or_unknown(column).alias("key"), or_unknown("label").alias("name"))
        return out.orderBy("key", "name").limit(FACET_ROWS)
    if name == "sessions":
        rows = rows.where(F.contains(ascii_lower(F.col(column)), ascii_lower(F.lit(search))))
    return rows.select(F.col(column).alias("key"), F.col(column).alias("name")).distinct().orderBy("key").limit(SESSION_ROWS if name == "sessions" else FACET_ROWS)


def facets(facts: DataFrame, q: Query, clock: Clock, search: str = "") -> DataFrame:
    """All facets as (facet, key, name); the locations' on the repo tab only."""
    names = [n for n in FACETS if q.tab == "repo" or n not in ("repositories", "directories")]
    parts = [facet(facts, q, clock, n, search).select(F.lit(n).alias("facet"), "key", "name") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Dashboard:
    rows: DataFrame
    chart: DataFrame
    summary: DataFrame
    synced: DataFrame
    page: int
    page_size: int
    row_count: int
    range: str


def dashboard(facts: DataFrame, query: Query, clock: Clock, max_rows: int | None = None) -> Dashboard:
    """A page of rows with chart and summary. With max_rows: all rows, or TooManyRows."""
    q = normalize(query)
    n = group_count(facts, q, clock).first()["n_groups"]
    if max_rows is not None:
        if not 1 <= max_rows <= MOST_ROWS:
            raise ValueError("invalid row limit")
        if n > max_rows:
            raise TooManyRows(f"{n} rows, at most {max_rows} allowed")
        q = replace(q, page=1)
    number = min(q.page, max(1, -(-n // q.page_size)))
    rows = page(facts, q, clock, n) if max_rows is None else ordered(grouped(facts, q, clock), q.sort, q.direction)
    s = q.selection
    shown = f"{s.day_from}..{s.day_to}" if s.day_from or s.day_to else {"all": "all time"}.get(s.period, s.period)
    return Dashboard(rows, chart(facts, q, clock), summary(facts, q, clock), synced_sessions(facts), number, q.page_size, n, shown)
