"""Calendar, clock and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"^([01]?\d|2[0-3]):[0-5]?\d$"


def minutes(clock: Column) -> Column:
    """'HH:MM' as minutes; null for anything else."""
    parts = F.split(clock, ":")
    return F.when(clock.rlike(_CLOCK), F.get(parts, F.lit(0)).cast("int") * 60 + F.get(parts, F.lit(1)).cast("int"))


def clock(value: Column) -> Column:
    """Minutes as 'HH:MM', around midnight; null stays null."""
    m = F.pmod(F.bround(value).cast("int"), F.lit(1440))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def hours_open(opens: Column, closes: Column) -> Column:
    """Hours from opening to closing minutes; over midnight where closing is earlier."""
    gap = (closes - opens) / 60.0
    return F.when(gap < 0, gap + 24).otherwise(gap)


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    d, e = F.floor(b / 4), b % 4
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = F.floor((a + 11 * h + 22 * m) / 451)
    month = F.floor((h + m - 7 * n + 114) / 31)
    day = (h + m - 7 * n + 114) % 31 + 1
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th given weekday (Monday 0) of a month; n = -1 is the last."""
    first = F.make_date(year.cast("int"), F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(first, (F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1)).cast("int"))
    end = F.last_day(first)
    return F.date_sub(end, F.pmod(F.weekday(end) - weekday, F.lit(7)).cast("int"))


def on_or_after(date: Column, weekday: int) -> Column:
    return F.date_add(date, F.pmod(F.lit(weekday) - F.weekday(date), F.lit(7)).cast("int"))


def on_or_before(date: Column, weekday: int) -> Column:
    return F.date_sub(date, F.pmod(F.weekday(date) - weekday, F.lit(7)).cast("int"))


def iso_monday(year: Column, week: int) -> Column:
    """Monday of an ISO week: the week of January 4 is the first."""
    return F.date_add(on_or_before(F.make_date(year.cast("int"), F.lit(1), F.lit(4)), 0), 7 * (week - 1))
