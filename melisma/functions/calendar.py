"""Hebrew calendar arithmetic and the date dimension that seasonal rules join with."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

#: Parts (1/1080 hours) of a month and of the first new moon, and the day number of the epoch.
_MONTH, _FIRST = 29 * 25920 + 12 * 1080 + 793, 1 * 25920 + 5 * 1080 + 204
_EPOCH = -1373428  # proleptic day number (0001-01-01 is 1) of 1 Tishri 1, less one


def is_leap(year: int) -> bool:
    return (7 * year + 1) % 19 < 7


def _elapsed(year: int) -> int:
    """Days from the epoch to the first of Tishri, by new moon and postponements."""
    months = (235 * year - 234) // 19
    parts = 12084 + 13753 * months
    day = 29 * months + parts // 25920
    return day + 1 if 3 * (day + 1) % 7 < 3 else day


def new_year(year: int) -> int:
    """Day number of 1 Tishri."""
    before, now, after = _elapsed(year - 1), _elapsed(year), _elapsed(year + 1)
    return _EPOCH + now + (2 if after - now == 356 else 1 if now - before == 382 else 0) + 1


def months(year: int) -> list[tuple[str, int]]:
    """Names and lengths of a year's months, from Tishri."""
    size = new_year(year + 1) - new_year(year)
    full, short = size % 10 == 5, size % 10 == 3
    names = [("Tishri", 30), ("Heshvan", 30 if full else 29), ("Kislev", 29 if short else 30), ("Tevet", 29), ("Shevat", 30)]
    names += [("Adar I", 30), ("Adar II", 29)] if is_leap(year) else [("Adar", 29)]
    return names + [("Nisan", 30), ("Iyar", 29), ("Sivan", 30), ("Tammuz", 29), ("Av", 30), ("Elul", 29)]


def hebrew_date(day: dt.date) -> tuple[int, str, int]:
    """Year, month and day of the Hebrew date on which this day's daylight falls."""
    n = day.toordinal()
    year = day.year + 3761
    while new_year(year) > n:
        year -= 1
    rest = n - new_year(year)
    for name, size in months(year):
        if rest < size:
            return year, name, rest + 1
        rest -= size
    raise AssertionError("unreachable")


def in_three_weeks(day: dt.date) -> bool:
    """17 Tammuz to 9 Av."""
    _, month, d = hebrew_date(day)
    return month == "Tammuz" and d >= 17 or month == "Av" and d <= 9


def clean_window(last: dt.date, days: int) -> bool:
    """Whether none of the days + 1 days up to the last is in season."""
    return not any(in_three_weeks(last - dt.timedelta(k)) for k in range(days + 1))


def dimension(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """day, heb_year, heb_month, heb_day, in_season: a small table to broadcast."""
    rows = []
    for n in range(first.toordinal(), last.toordinal() + 1):
        day = dt.date.fromordinal(n)
        rows.append((day, *hebrew_date(day), in_three_weeks(day)))
    return spark.createDataFrame(rows, "day date, heb_year int, heb_month string, heb_day int, in_season boolean")
