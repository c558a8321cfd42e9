"""Calendars: excluded days and times of day."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from wharfline.functions.text import col


@dataclass(frozen=True)
class Calendar:
    """holidays: yyyy-MM-dd, or MM-dd for each year; windows: ('HH:mm:ss', 'HH:mm:ss'), both ends inside, over midnight if reversed."""

    holidays: tuple[str, ...] = ()
    weekends: bool = True
    windows: tuple[tuple[str, str], ...] = field(default=())


def is_excluded(ts: Column | str, calendar: Calendar | None) -> Column:
    """Whether the time falls on a day or into a window that the calendar excludes; no calendar excludes nothing."""
    if calendar is None:
        return F.lit(False)
    t = col(ts)
    out = F.lit(False)
    if calendar.holidays:
        out = out | F.date_format(t, "yyyy-MM-dd").isin(*calendar.holidays) | F.date_format(t, "MM-dd").isin(*calendar.holidays)
    if calendar.weekends:
        out = out | F.dayofweek(t).isin(1, 7)
    clock = F.date_format(t, "HH:mm:ss")
    for a, b in calendar.windows:
        inside = clock.between(a, b) if a <= b else (clock >= a) | (clock <= b)
        out = out | inside
    return out


def next_available(ts: Column | str, calendar: Calendar | None, days: int = 7) -> Column:
    """The first of the following minutes that isn't excluded, within ``days``; else that many days later.

    Candidates are the time itself, the minutes after each window's end and midnights, since a wait can end
    only there; they are few, while the minutes of a week are many.
    """
    t = col(ts)
    if calendar is None:
        return t
    day = F.date_trunc("day", t)
    minute = lambda clock: int(clock[:2]) * 60 + int(clock[3:5])
    marks = sorted({0, *(minute(b) + k for _, b in calendar.windows for k in (0, 1))})
    at = [F.timestamp_seconds(F.unix_seconds(day) + d * 86400 + m * 60 + F.second(t)) for d in range(days + 1) for m in marks]
    last = F.timestamp_seconds(F.unix_seconds(t) + days * 86400)
    later = F.filter(F.array(*at), lambda x: (x > t) & (x < last) & ~is_excluded(x, calendar))
    return F.when(~is_excluded(t, calendar), t).otherwise(F.coalesce(F.array_min(later), last))
