"""Calendar columns in a reporting zone: an IANA name, or @seconds for a fixed offset."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date, datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def spark_zone(zone: str) -> str:
    """@19800 as +05:30; names as they are."""
    if not zone.startswith("@"):
        return zone
    seconds = int(zone[1:])
    hours, minutes = divmod(abs(seconds) // 60, 60)
    return f"{'-' if seconds < 0 else '+'}{hours:02d}:{minutes:02d}"


def python_zone(zone: str) -> tzinfo:
    return timezone(timedelta(seconds=int(zone[1:]))) if zone.startswith("@") else ZoneInfo(zone)


def bucket(ms: str | Column, zone: str, unit: str) -> Column:
    """The local day, Monday of the week, month or year of an instant, as text; an unknown unit is a day."""
    unit = unit if unit in UNITS else "day"
    local = F.from_utc_timestamp(F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms), spark_zone(zone))
    return F.date_format(F.date_trunc(unit, local), UNITS[unit])


def server_date(ms: str | Column, zone: str, time: bool = False) -> Column:
    """Jan 1, 2026 in the zone, with the time Jan 1, 2026, 00:30."""
    local = F.from_utc_timestamp(F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms), spark_zone(zone))
    return F.date_format(local, "MMM d, yyyy, HH:mm" if time else "MMM d, yyyy")


def start_of_day(day: date, zone: str) -> int:
    """Unix milliseconds of local midnight."""
    return round(datetime(day.year, day.month, day.day, tzinfo=python_zone(zone)).timestamp() * 1000)


def rfc3339_ms(text: Column) -> Column:
    """Milliseconds of a strict RFC 3339 time, rounded down; null for anything else (bare dates too)."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(shape), F.unix_millis(F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp")))


#: Fixed value: what a zone is called that can't be resolved; its times are UTC's.
NO_ZONE = "UTC (server timezone unavailable)"


def is_zone(name: str) -> bool:
    """Whether a zone database has the name."""
    try:
        return name not in ("", "Local") and ZoneInfo(name) is not None
    except (KeyError, ValueError, OSError):
        return False


def resolve_zone(advertised: str) -> tuple[str, str]:
    """(label, zone in this module's notation) of a zone as servers advertise it: UTC+hh:mm or an IANA name."""
    if fixed := re.match(r"UTC([+-])([0-9]{2}):([0-9]{2})\Z", advertised):
        sign, hours, minutes = fixed[1], int(fixed[2]), int(fixed[3])
        if hours < 24 and minutes < 60:
            return advertised, f"@{'-' if sign == '-' else ''}{hours * 3600 + minutes * 60}"
    elif is_zone(advertised):
        return advertised, advertised
    return NO_ZONE, "UTC"


def reporting_zone(environment: Mapping[str, str], localtime: str = "", offset_seconds: int = 0, configured: str = "") -> str:
    """The zone to advertise: the configured name, else that of TZ or of what /etc/localtime points at, as only names know past
    changes of the clock; else the offset that holds now."""
    told = environment.get("TZ", "").removeprefix(":") or localtime
    names = (configured, told.split("zoneinfo/", 1)[-1])
    hours, rest = divmod(abs(offset_seconds), 3600)
    return next(filter(is_zone, names), f"UTC{'-' if offset_seconds < 0 else '+'}{hours:02d}:{rest // 60:02d}")
