"""Dates and weeks. A week is named by its Monday; everything is plain date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WEEK_EPOCH = "1970-01-05"  # a Monday, so week numbers are whole


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def week_start(day: Column | str) -> Column:
    """Monday of the week that holds the day."""
    day = _c(day).cast("date")
    return F.date_sub(day, F.weekday(day))


def closing_monday(day: Column | str) -> Column:
    """First Monday on or after the day: the Monday whose trailing 7 days (w-6 .. w) hold it."""
    day = _c(day).cast("date")
    return F.date_add(day, F.pmod(F.lit(7) - F.weekday(day), F.lit(7)))


def week_number(monday: Column | str) -> Column:
    """Whole weeks since the epoch Monday; consecutive Mondays differ by one."""
    return (F.datediff(_c(monday), F.lit(WEEK_EPOCH).cast("date")) / F.lit(7)).cast("int")


def week_sequence(first: Column | str, last: Column | str) -> Column:
    """All Mondays from the week of ``first`` to the week of ``last``; empty if reversed."""
    first, last = week_start(first), week_start(last)
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 7 days"))).otherwise(
        F.array().cast("array<date>")
    )


def parse_day(text: Column | str, pattern: str | None = None) -> Column:
    """Date, or null when the text is not one."""
    return parse_instant(text, pattern).cast("date")


def parse_instant(text: Column | str, pattern: str | None = None) -> Column:
    """Timestamp in the session zone (UTC), or null when the text is not one."""
    text = F.trim(_c(text).cast("string"))
    if pattern is None:
        return text.try_cast("timestamp")
    return F.try_to_timestamp(text, F.lit(pattern))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end; null if either is unknown."""
    return F.datediff(_c(end), _c(start)).cast("long")


def within_days(days: Column | str, limit: int) -> Column:
    """1 if the distance is known and at most ``limit``, else 0."""
    return F.coalesce((_c(days) <= limit).cast("long"), F.lit(0).cast("long"))
