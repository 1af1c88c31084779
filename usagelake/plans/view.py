"""What viewers do with a query and its rows: transitions, columns, charts, labels. Pure functions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal
from typing import Any
from urllib.parse import parse_qs, urlencode

from .query import SORTS, InvalidQuery, Query, Selection, period_days

#: What each tab shows.
COLUMNS = {
    "tokens": ("date", "total", "input", "output", "reasoning", "cacheRead", "cacheWrite", "sessions"),
    "models": ("name", "total", "input", "output", "reasoning", "cacheRead", "cacheWrite", "sessions"),
    "sessions": ("name", "date", "total", "input", "output", "reasoning", "cacheRead", "cacheWrite", "context"),
    "context": ("harness", "provider", "model", "averageContext", "medianContext", "maxContext", "sessions"),
    "repo": ("name", "providers", "harnesses", "models", "total", "input", "output", "reasoning", "cacheRead", "cacheWrite", "sessions"),
}
COLUMNS |= dict.fromkeys(("providers", "harnesses"), COLUMNS["models"])
_KEYS = {"day_from": "from", "day_to": "to", "providers": "provider", "models": "model", "harnesses": "harness", "sessions": "session"}
_LISTS = ("providers", "models", "harnesses", "sessions")


def with_tab(q: Query, tab: str) -> Query:
    """Another tab: first page, its own order, and no location options off the repo tab."""
    out = replace(q, tab=tab, page=1, sort="", direction="")
    return out if tab == "repo" else replace(out, location_group="", repositories=(), directories=())


def with_sort(q: Query, sort: str) -> Query:
    """Another order; the same one is turned round."""
    if sort not in SORTS[q.tab or "tokens"]:
        raise InvalidQuery(f"invalid sort for {q.tab}")
    turned = {"asc": "desc", "desc": "asc"}.get(q.direction, "asc")
    return replace(q, sort=sort, direction=turned if sort == q.sort else "", page=1)


def with_selection(q: Query, **changes) -> Query:
    return replace(q, selection=replace(q.selection, **changes), page=1)


def cleared(q: Query) -> Query:
    """No dimension or location filters; period and bucket stay."""
    return replace(with_selection(q, providers=(), models=(), harnesses=(), sessions=()), repositories=(), directories=())


def excluded_usage(q: Query) -> Query:
    """The companion that tells how much usage is only estimated: one row of the same selection."""
    return replace(q, quality="estimated", tab="repo" if q.tab == "repo" else "tokens", sort="", direction="", page=1, page_size=1)


def facet_query(q: Query) -> Query:
    return replace(q, sort="", direction="", page=0, page_size=0)


def to_url(q: Query) -> str:
    """The query's parameters; defaults are left out."""
    pairs: list[tuple[str, str]] = []
    for f in fields(Selection):
        value = getattr(q.selection, f.name)
        pairs += [(_KEYS.get(f.name, f.name), v) for v in (value if isinstance(value, tuple) else (value,)) if v]
    for name, key in (("quality", "quality"), ("tab", "tab"), ("location_group", "locationGroup"), ("sort", "sort"), ("direction", "direction"), ("page", "page"), ("page_size", "pageSize")):
        if getattr(q, name):
            pairs.append((key, str(getattr(q, name))))
    return urlencode(pairs + [("repository", r) for r in q.repositories] + [("directory", d) for d in q.directories])


def from_url(text: str) -> Query:
    """The inverse; empty values and unknown keys are rejected."""
    found = parse_qs(text, keep_blank_values=True)
    one = {"period", "bucket", "from", "to", "quality", "tab", "locationGroup", "sort", "direction", "page", "pageSize"}
    for key, values in found.items():
        if key not in one | {"provider", "model", "harness", "session", "repository", "directory"} or (key in one and (len(values) > 1 or not values[0])):
            raise InvalidQuery(f"invalid parameter {key!r}")
    get = lambda k: found.get(k, [""])[0]
    try:
        page, size = (int(get(k)) if k in found else 0 for k in ("page", "pageSize"))
    except ValueError:
        raise InvalidQuery("invalid page") from None
    if ("page" in found and page < 1) or ("pageSize" in found and size < 1):
        raise InvalidQuery("invalid page")
    s = Selection(get("period"), get("bucket"), get("from"), get("to"), *(tuple(found.get(_KEYS[n], ())) for n in _LISTS))
    return Query(get("tab"), s, get("quality"), get("locationGroup"), tuple(found.get("repository", ())), tuple(found.get("directory", ())), get("sort"), get("direction"), page, size)


def compact(n: int) -> str:
    """1.2K, 3.4M and so on: one decimal, half up; what rounds to 1000 takes the next unit."""
    units = ("", "K", "M", "B", "T")
    scale = min(len(units) - 1, (len(str(abs(n))) - 1) // 3)
    while scale:
        tenths = (Decimal(n) / 1000**scale).quantize(Decimal("0.1"), ROUND_HALF_UP)
        if abs(tenths) < 1000 or scale == len(units) - 1:
            return f"{tenths:f}".removesuffix(".0") + units[scale]
        scale += 1
    return str(n)


def share(part: int, total: int) -> str:
    """A percentage with one decimal; under a tenth it only says so."""
    if not total or not part:
        return "0%"
    value = Decimal(part) * 100 / Decimal(total)
    if value < Decimal("0.1"):
        return "<0.1%"
    return f"{value.quantize(Decimal('0.1'), ROUND_HALF_UP):f}".removesuffix(".0") + "%"


def label(text: str) -> str:
    """A chart label of 17 UTF-16 units at most."""
    units = text.encode("utf-16-le")
    return text if len(units) <= 34 else units[:30].decode("utf-16-le", "ignore") + "…"


def shifted(period: str, first: date, step: int) -> tuple[date, date]:
    """The period's range that many periods later, for a range that begins on `first`: first and last day."""
    if period in ("today", "yesterday", "week"):
        days = 7 if period == "week" else 1
        start = first + timedelta(days=days * step)
        return start, start + timedelta(days=days - 1)
    months = first.year * 12 + first.month - 1 + step * (12 if period == "year" else 1)
    start, after = (date(m // 12, m % 12 + 1, 1) for m in (months, months + (12 if period == "year" else 1)))
    return start, after - timedelta(days=1)


def is_complete(period: str, first: date, last: date) -> bool:
    """Whether the days are just one whole period."""
    begins = {"week": first.weekday() == 0, "month": first.day == 1, "year": (first.month, first.day) == (1, 1)}.get(period, True)
    return begins and shifted(period, first, 0) == (first, last)


def chart_kind(tab: str) -> str:
    return "timeline" if tab in ("tokens", "sessions") else "categories"


def lines(text: str) -> list[str]:
    """Parts of a joined list, each once."""
    return list(dict.fromkeys(p.strip() for p in text.split(",") if p.strip()))


#: What filters and periods are called.
DIMENSIONS = (("harnesses", "Harness"), ("providers", "Provider"), ("models", "Model"), ("sessions", "Session"))
LOCATIONS = (("repositories", "Repository"), ("directories", "Directory"))
PERIOD_LABELS = {"today": "Daily", "week": "Weekly", "month": "Monthly", "year": "Yearly", "all": "All time"}


def custom_dates(q: Query) -> bool:
    return bool(q.selection.day_from or q.selection.day_to)


def active_filters(q: Query) -> list[str]:
    """Labels of the filters that are set, in the toolbar's order."""
    out = [name for key, name in DIMENSIONS if getattr(q.selection, key)]
    if q.tab == "repo":
        out += [name for key, name in LOCATIONS if getattr(q, key)]
    return out + ["Dates"] * custom_dates(q)


def missing_name(key: str) -> str:
    """What a selected location that is no longer offered is called."""
    return f"{dict(LOCATIONS)[key]} (unavailable)"


def date_label(q: Query) -> str:
    s = q.selection
    if custom_dates(q):
        return f"{s.day_from or 'Beginning'} → {s.day_to or 'Now'}"
    return PERIOD_LABELS.get(s.period, "Daily")


def custom_range_applies(first: str, last: str) -> bool:
    """Whether dates that were typed in can be taken: one at least, and not the wrong way round."""
    return bool(first or last) and not (first and last and first > last)


def short_date(d: date) -> str:
    return f"{d:%b} {d.day}, {d.year}"


def range_label(period: str, first: date, last: date) -> str:
    """2024; January 2024; Jan 1 – 7, 2024 with shared parts once; Jan 1, 2024."""
    if period == "year":
        return str(first.year)
    if period == "month":
        return f"{first:%B} {first.year}"
    if period != "week" or first == last:
        return short_date(first)
    begin = short_date(first) if first.year != last.year else f"{first:%b} {first.day}"
    end = short_date(last) if (first.year, first.month) != (last.year, last.month) else f"{last.day}, {last.year}"
    return f"{begin} – {end}"


@dataclass(frozen=True)
class Navigation:
    """The period shown, and whether there is a later one to go to."""

    first: date
    last: date
    label: str
    at_current: bool


def navigation(q: Query, today: date, first: date | None = None) -> Navigation | None:
    """The period shown, that of `first` (unset: of the query's own period); None for custom dates and all time."""
    s = q.selection
    if custom_dates(q) or s.period == "all":
        return None
    own = period_days(s.period or "month", today)
    current = period_days("today" if s.period == "yesterday" else s.period or "month", today)
    begin = first or own[0]
    begin, last = shifted(s.period or "month", begin, 0)
    return Navigation(begin, last, range_label(s.period or "month", begin, last), begin >= current[0])


#: Stages of collecting, and what they are called.
STAGES = {"waiting": "Waiting to collect", "capturing": "Collecting usage", "submitting": "Submitting usage", "accepted": "Usage accepted", "failed": "Collection failed", "interrupted": "Collection interrupted"}
ACTIVE = ("waiting", "capturing", "submitting")


@dataclass(frozen=True)
class Sync:
    collection_unknown: bool = False
    collection_failed: bool = False
    stage: str = ""
    pending: bool = False
    backoff: bool = False
    loading: bool = False


def sync_state(attempts: list[dict], pending: int, failed: int, retry_at_ms: int, now_ms: int, generation: int, target: int, progress_failed: bool = False, checked: str = "") -> Sync:
    """attempts: dicts of id, stage and updated_ms. An accepted attempt counts as collecting until it has been `checked`."""
    active = next((a for a in attempts if a["stage"] in ACTIVE), None)
    latest = max(enumerate(attempts), key=lambda x: (x[1]["updated_ms"], x[0]), default=(0, None))[1]
    accepted = f"{latest['id']}/{latest['updated_ms']}" if latest and latest["stage"] == "accepted" else ""
    collecting = not progress_failed and (active is not None or (accepted != "" and accepted != checked))
    processing = pending > 0 or generation != target
    return Sync(progress_failed, bool(latest) and latest["stage"] in ("failed", "interrupted"), active["stage"] if active and not progress_failed else "", processing, failed > 0 and retry_at_ms > now_ms, collecting or processing)


def status(sync: Sync, connection_failed: bool = False, refresh_failed: bool = False, refreshing: bool = False, usage_failed: bool = False, facets_failed: bool = False, fetching: bool = False, loaded: bool = True, facets_pending: bool = False) -> tuple[str, str]:
    """(label, tone) of the one thing that matters most now."""
    ranked = [
        (connection_failed, "Connection unavailable", "attention"), (refresh_failed, "Refresh failed", "attention"), (refreshing, "Refreshing usage…", "loading"), (usage_failed, "Usage couldn’t load", "attention"),
        (facets_failed, "Filters couldn’t load", "attention"), (sync.collection_unknown, "Collection status unavailable", "attention"), (sync.collection_failed, "Collection needs attention", "attention"), (bool(sync.stage), STAGES.get(sync.stage, ""), "loading"),
        (sync.pending and sync.backoff, "Processing retry pending", "attention"), (sync.pending, "Processing usage", "loading"), (sync.loading, "Loading…", "loading"), (fetching and loaded, "Refreshing usage…", "loading"), (fetching, "Loading…", "loading"), (facets_pending, "Loading filters…", "loading"),
    ]
    return next(((label, tone) for holds, label, tone in ranked if holds), ("Ready", "ready"))


#: Columns of a table by what kind of cell they have, and the row's field that each shows.
COUNTED = {"total": "total", "input": "input", "output": "output", "reasoning": "reasoning", "cacheRead": "cache_read", "cacheWrite": "cache_write", "sessions": "sessions", "context": "context", "averageContext": "average_context", "medianContext": "median_context", "maxContext": "max_context"}
NAMED = ("name", "harness", "provider", "model")


def row_value(row: Mapping[str, Any], column: str) -> int | None:
    """A row's count in a column; None in a column of text."""
    return row[COUNTED[column]] if column in COUNTED else None


def row_text(row: Mapping[str, Any], column: str) -> str:
    """A row's text in a column; '' in others."""
    return row[column] if column in NAMED else ""


def is_unknown_location(row: Mapping[str, Any], tab: str) -> bool:
    """Whether the row stands for usage without a known place, which is named so beside the directories that it had."""
    return tab == "repo" and row["location_key"] == "unknown"
