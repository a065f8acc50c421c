"""Exact microsecond arithmetic on TIMESTAMP_NTZ columns.

``timestampdiff``/``timestampadd`` on NTZ values do not depend on the
session time zone, so bucket edges are the same on every cluster.
"""
from __future__ import annotations

import calendar as _calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000

# Fixed widths accepted for tumbling intervals (pandas offset aliases).
_UNIT_US = {
    "W": 7 * US_PER_DAY,
    "D": US_PER_DAY,
    "H": 3_600_000_000,
    "h": 3_600_000_000,
    "min": 60_000_000,
    "T": 60_000_000,
    "S": 1_000_000,
    "s": 1_000_000,
}


def parse_interval(text: str) -> tuple[int, bool]:
    """``'28D'`` -> (width in microseconds, week-anchored?).

    ``W`` is calendar anchored on Sundays like pandas' ``W-SUN``; the other
    units are plain fixed widths.  Month, quarter and year aliases have no
    fixed width; see :func:`calendar_interval`.
    """
    m = re.fullmatch(r"\s*(\d*)\s*(W|D|H|h|min|T|S|s)\s*", text)
    if not m:
        raise ValueError(f"unsupported interval {text!r}; use a fixed width "
                         "such as '7D', '1W', '12H', '30min' or '45S'")
    n = int(m.group(1) or 1)
    if n <= 0:
        raise ValueError(f"interval must be positive: {text!r}")
    unit = m.group(2)
    return n * _UNIT_US[unit], unit == "W"


# Calendar intervals: months of a step, and whether edges are first or last days (pandas offset aliases).
_MONTHS = {"M": 1, "ME": 1, "MS": 1, "Q": 3, "QE": 3, "QS": 3, "Y": 12, "YE": 12, "A": 12, "YS": 12, "AS": 12}
_WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def calendar_interval(text: str):
    """``(n, unit)`` of a calendar interval such as ``'MS'``, ``'2M'``, ``'QS'``, ``'Y'`` or ``'W-MON'``;
    None for any other text."""
    m = re.fullmatch(r"\s*(\d*)\s*(" + "|".join(_MONTHS) + r"|W-(?:" + "|".join(_WEEKDAYS) + r"))\s*", text)
    if not m:
        return None
    n = int(m.group(1) or 1)
    if n <= 0:
        raise ValueError(f"interval must be positive: {text!r}")
    return n, m.group(2)


def add_months(day: dt.datetime, n: int) -> dt.datetime:
    """``day`` n months later, on the same day of the month or the last one there is."""
    at = day.year * 12 + day.month - 1 + n
    year, month = at // 12, at % 12 + 1
    return day.replace(year=year, month=month, day=min(day.day, _calendar.monthrange(year, month)[1]))


def advance(when: dt.datetime, text: str) -> dt.datetime:
    """One interval later: a fixed width, or by the calendar."""
    found = calendar_interval(text)
    if found is None:
        return when + dt.timedelta(microseconds=parse_interval(text)[0])
    n, unit = found
    return when + dt.timedelta(weeks=n) if unit.startswith("W-") else add_months(when, n * _MONTHS[unit])


def calendar_edges(lo: dt.datetime, hi: dt.datetime, text: str) -> list:
    """Edges from the first anchor day on or after ``lo`` (at its time of day) up to ``hi``."""
    n, unit = calendar_interval(text)
    edges = []
    if unit.startswith("W-"):
        at = lo + dt.timedelta(days=(_WEEKDAYS.index(unit[2:]) - lo.weekday()) % 7)
        while at <= hi:
            edges.append(at)
            at += dt.timedelta(weeks=n)
        return edges
    months, first_days = _MONTHS[unit], unit.endswith("S")
    at = lo.replace(day=1)
    if first_days and lo.day > 1:
        at = add_months(at, 1)
    while (at.month - 1) % months if first_days else at.month % months:
        at = add_months(at, 1)
    while True:
        edge = at if first_days else at.replace(day=_calendar.monthrange(at.year, at.month)[1])
        if edge > hi:
            return edges
        edges.append(edge)
        at = add_months(at, n * months)


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a string / datetime."""
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.expr(f"TIMESTAMP_NTZ'{value}'")


def micros_between(start: Column, end: Column) -> Column:
    """end - start in microseconds (BIGINT)."""
    return F.timestamp_diff("MICROSECOND", start, end)


def add_micros(ts: Column, n: Column) -> Column:
    return F.timestamp_add("MICROSECOND", n, ts)


def day_delta(ts: Column, earliest: Column) -> Column:
    """Whole days from ``earliest`` to ``ts``, floored (negative allowed)."""
    return F.floor(micros_between(earliest, ts) / F.lit(float(US_PER_DAY))).cast("bigint")


def add_days(ts: Column, n: Column) -> Column:
    return F.timestamp_add("DAY", n, ts)


def ts_text(ts: Column) -> Column:
    """pandas-style text: seconds precision, fraction only when non-zero."""
    frac = F.pmod(micros_between(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts),
                  F.lit(1_000_000))
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.when(frac != 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0")))
        .otherwise(F.lit("")),
    )
