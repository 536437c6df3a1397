"""Report periods (codes resolved once on the driver into date literals).

'CST' uses the dates given by the caller; 'YTD' runs from 1 January of the
reference day up to and including that day.  Any other code is rejected
rather than guessed.  The reference day is always explicit so a report does
not drift with the clock.
"""

from __future__ import annotations

import datetime as dt


def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def resolve_period(code: str | None, start=None, end=None, as_of=None) -> tuple[dt.date, dt.date]:
    if code == "CST":
        if start is None or end is None:
            raise ValueError("period 'CST' needs start and end dates")
        return as_date(start), as_date(end)
    if code == "YTD":
        if as_of is None:
            raise ValueError("period 'YTD' needs the reference day as_of")
        day = as_date(as_of)
        return dt.date(day.year, 1, 1), day
    raise ValueError(f"unknown period code {code!r}")


def months_before(day, months: int) -> dt.date:
    """Same day ``months`` earlier, clamped to the month's last day."""
    d = as_date(day)
    total = d.year * 12 + (d.month - 1) - months
    year, month = divmod(total, 12)
    month += 1
    for day_of_month in range(d.day, 27, -1):
        try:
            return dt.date(year, month, day_of_month)
        except ValueError:
            continue
    return dt.date(year, month, min(d.day, 28))
