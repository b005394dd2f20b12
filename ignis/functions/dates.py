"""Calendar features.  Bad dates are NULL, never an error (ANSI ``make_date``
raises, so dates are built with ``try_to_date``)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_date(year, month, day) -> Column:
    """Date from parts; NULL if any part is missing or the date does not exist."""
    y, m, d = _c(year).cast("int"), _c(month).cast("int"), _c(day).cast("int")
    text = F.concat_ws("-", y, m, d)
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(),
                  F.try_to_date(text, "yyyy-M-d"))


def day_of_year(year, month, day, calendar: str = "leap2000", on_bad: str = "null") -> Column:
    """Day of year in three flavours.

    * ``calendar='leap2000'``: month/day placed in the leap year 2000 (1..366)
      regardless of the real year.
    * ``calendar='actual'``: the real year.
    * ``on_bad='fallback'``: a missing/out-of-range month falls back to 1 and an
      out-of-range day to 1; a missing month still gives NULL.  A day that does
      not exist in the month (31 April) is NULL rather than an error.
    """
    m, d = _c(month).cast("int"), _c(day).cast("int")
    y = F.lit(2000) if calendar == "leap2000" else _c(year).cast("int")
    if on_bad == "fallback":
        yy = F.coalesce(y, F.lit(2000)) if calendar != "leap2000" else y
        mm = F.when(m.between(1, 12), m).otherwise(F.lit(1))
        dd = F.when(d.between(1, 31), d).otherwise(F.lit(1))
        return F.when(_c(month).isNotNull(), F.dayofyear(safe_date(yy, mm, dd)))
    if on_bad == "strict_parts":
        ok = _c(year).isNotNull() & m.between(1, 12) & d.between(1, 31)
        return F.when(ok, F.dayofyear(safe_date(y, m, d)))
    return F.dayofyear(safe_date(y, m, d))


def doy_sin(doy) -> Column:
    return F.sin(F.lit(2.0 * math.pi) * _c(doy) / F.lit(365.0))


def doy_cos(doy) -> Column:
    return F.cos(F.lit(2.0 * math.pi) * _c(doy) / F.lit(365.0))


def day_of_week(year, month, day, year_range: tuple[int, int] | None = None) -> Column:
    """Weekday with 0 = Monday (``weekday``; ``dayofweek`` is 1 = Sunday)."""
    dt = safe_date(year, month, day)
    if year_range is not None:
        y = _c(year).cast("int")
        dt = F.when(y.between(*year_range), dt)
    return F.weekday(dt)


def weekend_flag(dow, missing_as_zero: bool = True) -> Column:
    """``dow >= 5`` as double.  The main variant maps a missing weekday to 0.0,
    the older variant keeps it missing."""
    flag = (_c(dow) >= 5).cast("double")
    return F.coalesce(flag, F.lit(0.0)) if missing_as_zero else flag
