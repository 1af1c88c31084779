"""A dashboard query as a value: defaults, validation, and the instants that its period stands for."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta

from ..functions.calendar import python_zone, start_of_day
from ..schemas import HARNESSES

PERIODS = ("today", "yesterday", "week", "month", "year", "all")
BUCKETS = ("day", "week", "month", "year")
TABS = ("tokens", "models", "providers", "harnesses", "sessions", "context", "repo")
_COMMON = ("name", "date", "total", "input", "output", "reasoning", "cacheRead", "cacheWrite", "sessions", "context")
_DIMENSIONS = ("harness", "provider", "model")
SORTS = dict.fromkeys(TABS, _COMMON) | {"repo": (*_COMMON, *_DIMENSIONS), "context": ("averageContext", "medianContext", "maxContext", "sessions", *_DIMENSIONS)}
#: Result columns that the sort names stand for, where they differ.
SORT_COLUMNS = {"cacheRead": "cache_read", "cacheWrite": "cache_write", "averageContext": "average_context", "medianContext": "median_context", "maxContext": "max_context"}
MOST_ROWS, PAGE_SIZE, MOST_PAGE_SIZE, CHART_ROWS, TIMELINE_ROWS, FACET_ROWS, SESSION_ROWS = 100_000, 50, 200, 12, 1000, 1000, 100


class InvalidQuery(ValueError):
    """The query names something that doesn't exist or that doesn't go together."""


@dataclass(frozen=True)
class Selection:
    period: str = ""
    bucket: str = ""
    day_from: str = ""
    day_to: str = ""
    providers: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    harnesses: tuple[str, ...] = ()
    sessions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    tab: str = ""
    selection: Selection = field(default_factory=Selection)
    quality: str = ""
    location_group: str = ""
    repositories: tuple[str, ...] = ()
    directories: tuple[str, ...] = ()
    sort: str = ""
    direction: str = ""
    page: int = 0
    page_size: int = 0


def _day(text: str) -> date | None:
    if not text:
        return None
    try:
        return datetime.strptime(text, "%Y-%m-%d").date() if len(text) == 10 else date.fromisoformat("")
    except ValueError:
        raise InvalidQuery(f"invalid date {text!r}: use YYYY-MM-DD") from None


def _one_of(what: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise InvalidQuery(f"invalid {what} {value!r}")
    return value


def normalize(q: Query) -> Query:
    """The query with all defaults, or InvalidQuery."""
    s = replace(q.selection, period=q.selection.period or "month", bucket=q.selection.bucket or "day")
    _one_of("period", s.period, PERIODS)
    _one_of("bucket", s.bucket, BUCKETS)
    if (first := _day(s.day_from)) and (last := _day(s.day_to)) and first > last:
        raise InvalidQuery("from must not be after to")
    for h in s.harnesses:
        _one_of("harness", h, HARNESSES)
    tab = _one_of("tab", q.tab or "tokens", TABS)
    if tab != "repo" and (q.location_group or q.repositories or q.directories):
        raise InvalidQuery("location options require the repo tab")
    group = _one_of("location group", q.location_group or "repository", ("repository", "directory")) if tab == "repo" else ""
    sort = _one_of(f"sort for {tab}", q.sort or {"tokens": "date", "sessions": "date", "context": "averageContext"}.get(tab, "total"), SORTS[tab])
    direction = _one_of("direction", q.direction or ("asc" if sort in ("name", *_DIMENSIONS) else "desc"), ("asc", "desc"))
    page, size = q.page or 1, q.page_size or PAGE_SIZE
    if page < 1 or not 1 <= size <= MOST_PAGE_SIZE:
        raise InvalidQuery("invalid page or page size")
    return Query(tab, s, _one_of("quality", q.quality or "confirmed", ("confirmed", "estimated")), group, q.repositories, q.directories, sort, direction, page, size)


def period_days(period: str, today: date) -> tuple[date, date] | None:
    """First day and the day after the last one; weeks begin on Monday. None: all time."""
    if period == "all":
        return None
    monday, first = today - timedelta(days=today.weekday()), today.replace(day=1)
    next_month = (first + timedelta(days=32)).replace(day=1)
    return {
        "today": (today, today + timedelta(days=1)), "yesterday": (today - timedelta(days=1), today), "week": (monday, monday + timedelta(days=7)),
        "month": (first, next_month), "year": (today.replace(month=1, day=1), date(today.year + 1, 1, 1)),
    }[period]


def instants(s: Selection, now_ms: int, zone: str) -> tuple[int | None, int | None]:
    """[start, end) in Unix milliseconds. Days given by the user replace the period; both are local to the zone."""
    if s.day_from or s.day_to:
        first, last = _day(s.day_from), _day(s.day_to)
        return first and start_of_day(first, zone), last and start_of_day(last + timedelta(days=1), zone)
    days = period_days(s.period or "month", datetime.fromtimestamp(now_ms / 1000, python_zone(zone)).date())
    return (start_of_day(days[0], zone), start_of_day(days[1], zone)) if days else (None, None)
