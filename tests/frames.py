"""Short forms that several test modules share."""

from __future__ import annotations

import datetime


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def rows(df, *columns):
    """Collected rows as sorted tuples."""
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
