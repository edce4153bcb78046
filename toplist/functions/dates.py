"""Date parameters and the column rules for weeks, fortnights and leap years.

Every rule is a Column; on a literal reference date Catalyst folds it to a
constant, so one-date and set-valued operators share it.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO_DATE = re.compile("([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})")


def parse_date(date_str: str | None) -> date | None:
    """The date written as year, month and day with dashes, or ``None``.

    One-digit months and days are accepted, two-digit years are not; null,
    empty text and days that no month has give ``None``.
    """
    found = _ISO_DATE.fullmatch(date_str or "")
    if found is None:
        return None
    parts = [int(x) for x in found.groups()]
    try:
        return date(*parts)
    except ValueError:
        return None


def week_start_col(ref: Column) -> Column:
    """Sunday on or before ``ref`` (Spark ``dayofweek``: 1 = Sunday)."""
    return F.date_sub(ref, F.dayofweek(ref) - 1)


def week_days_col(ref: Column) -> Column:
    """Days of year matched by the week of ``ref``.

    The week's bounds are days of year in their own years; a week that crosses
    the new year matches from its first day on and up to its last.
    """
    ws = week_start_col(ref)
    s, e = F.dayofyear(ws), F.dayofyear(F.date_add(ws, 6))
    return F.when(s <= e, F.sequence(s, e)).otherwise(
        F.concat(F.sequence(s, F.lit(366)), F.sequence(F.lit(1), e))
    )


def fortnight_day_col(ref: Column) -> Column:
    return F.when(F.dayofmonth(ref) <= 14, F.lit(1)).otherwise(F.lit(15))


def is_leap_col(year: Column) -> Column:
    """Whether the year has a 29 February (its last day of February is the 29th)."""
    return F.dayofmonth(F.last_day(F.make_date(year, F.lit(2), F.lit(1)))) == 29
