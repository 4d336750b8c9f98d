"""Dates. Patterns are Java date patterns, which Spark takes as they are.

Times without a zone stay without a zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions import ColumnLike, arg, col

# Unit names and pattern letters. Case matters: MM is month, mm is minute.
UNITS = {
    "yyyy": "YEAR", "year": "YEAR",
    "MM": "MONTH", "month": "MONTH",
    "quarter": "QUARTER", "week": "WEEK",
    "dd": "DAY", "day": "DAY",
    "HH": "HOUR", "hour": "HOUR",
    "mm": "MINUTE", "minute": "MINUTE",
    "ss": "SECOND", "second": "SECOND",
    "SSS": "MILLISECOND", "millisecond": "MILLISECOND",
}

# Percent codes of other dialects and their Java pattern.
PERCENT_CODES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%M": "MMMM", "%b": "MMM", "%d": "dd", "%e": "d",
    "%H": "HH", "%h": "hh", "%I": "hh", "%i": "mm", "%s": "ss", "%S": "ss", "%p": "a", "%W": "EEEE", "%a": "EEE", "%j": "DDD",
}


def unit_name(unit: str) -> str:
    """Spark unit of a unit word or pattern letters."""
    found = UNITS.get(unit) or UNITS.get(unit.lower())
    if found is None:
        raise ValueError(f"unknown date unit {unit!r}")
    return found


def java_pattern(percent: str) -> str:
    """Java pattern of a percent pattern such as ``%Y-%m-%d``; other text is quoted."""
    out, i, text = [], 0, ""
    while i < len(percent):
        code = PERCENT_CODES.get(percent[i : i + 2])
        if code:
            out.append((f"'{text}'" if any(ch.isalpha() for ch in text) else text) + code)
            text, i = "", i + 2
        else:
            text, i = text + percent[i], i + 1
    return "".join(out) + (f"'{text}'" if any(ch.isalpha() for ch in text) else text)


def current_date() -> Column:
    return F.current_date()


def now() -> Column:
    return F.current_timestamp()


def current_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def format_date(pattern: str, value: ColumnLike) -> Column:
    """Date or time as text."""
    return F.date_format(col(value), pattern)


def format_date_locale(pattern: str, value: ColumnLike, locale: str = "") -> Column:
    """As ``format_date``; the locale has no effect."""
    return format_date(pattern, value)


def to_char(value: ColumnLike, pattern: str) -> Column:
    return format_date(pattern, value)


def date_format_percent(value: ColumnLike, percent: str) -> Column:
    """Format with a percent pattern."""
    return F.date_format(col(value), java_pattern(percent))


def parse_date(pattern: str, text: ColumnLike) -> Column:
    """Text to a time; fails on text that does not fit."""
    return F.to_timestamp_ntz(col(text), F.lit(pattern))


def parse_date_locale(pattern: str, text: ColumnLike, locale: str = "") -> Column:
    """As ``parse_date``; the locale has no effect."""
    return parse_date(pattern, text)


def to_date(text: ColumnLike, pattern: str) -> Column:
    return parse_date(pattern, text)


def str_to_date(text: ColumnLike, percent: str) -> Column:
    """Text to a time with a percent pattern."""
    return parse_date(java_pattern(percent), text)


def try_parse_date(pattern: str, text: ColumnLike) -> Column:
    """Text to a time, NULL where it does not fit."""
    return F.try_to_timestamp(col(text), F.lit(pattern)).cast("timestamp_ntz")


def is_date(text: ColumnLike, pattern: str) -> Column:
    """Whether text is a time of this pattern; false for NULL."""
    return F.try_to_timestamp(col(text), F.lit(pattern)).isNotNull()


def add_date(value: ColumnLike, amount: int | Column, unit: str) -> Column:
    """Add units; a month end is kept inside the month. The time of day stays."""
    return F.timestamp_add(unit_name(unit), arg(amount).cast("int"), col(value))


def add_to_date(value: ColumnLike, unit: str, amount: int | Column) -> Column:
    return add_date(value, amount, unit)


def diff_date(left: ColumnLike, right: ColumnLike, unit: str = "dd") -> Column:
    """Unit borders crossed from ``right`` to ``left``: 31 January to 1 February is one month. Weeks begin on Monday."""
    a, b = col(left), col(right)
    kind = unit_name(unit)
    if kind == "MILLISECOND":
        # Borders, so both ends are cut to whole milliseconds before they are compared.
        whole = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1000)
        return (whole(a) - whole(b)).cast("bigint")
    if kind == "QUARTER":
        return (F.year(a).cast("bigint") - F.year(b)) * 4 + F.quarter(a) - F.quarter(b)
    if kind == "WEEK":
        return (F.datediff(F.trunc(a, "week"), F.trunc(b, "week")) / 7).cast("bigint")
    years = F.year(a).cast("bigint") - F.year(b)
    if kind == "YEAR":
        return years
    if kind == "MONTH":
        return years * 12 + F.month(a) - F.month(b)
    total = F.datediff(a, b).cast("bigint")
    for step, size, part in (("DAY", 1, None), ("HOUR", 24, F.hour), ("MINUTE", 60, F.minute), ("SECOND", 60, F.second)):
        if part is not None:
            total = total * size + part(a) - part(b)
        if step == kind:
            return total
    raise ValueError(f"no border count for {unit!r}")


def diff_date_floor(left: ColumnLike, right: ColumnLike, unit: str = "dd") -> Column:
    """Complete units from ``right`` to ``left``: 31 January to 1 February is no month."""
    return F.timestamp_diff(unit_name(unit), col(right), col(left))


def compare_date(left: ColumnLike, right: ColumnLike, pattern: str | None = None) -> Column:
    """-1, 0 or 1. With a pattern only the days compare. NULL compares as 1."""
    a, b = col(left), col(right)
    if pattern is not None:
        a, b = a.cast("date"), b.cast("date")
    return F.when(a < b, -1).when(a == b, 0).otherwise(1)


# Calendar field names and their extract field.
CALENDAR_FIELDS = {
    "DAY_OF_MONTH": "DAY", "DATE": "DAY", "DAY_OF_YEAR": "DOY", "DAY_OF_WEEK": "DAYOFWEEK", "WEEK_OF_YEAR": "WEEK",
    "HOUR_OF_DAY": "HOUR",
}


def part_of_date(part: str, value: ColumnLike) -> Column:
    """A calendar field as a whole number. MONTH counts from 0, DOW from Sunday 0, DAY_OF_WEEK from Sunday 1."""
    name = part.upper()
    field = F.extract(F.lit(CALENDAR_FIELDS.get(name, name)), col(value)).cast("bigint")
    return field - 1 if name in ("MONTH", "DOW") else field


def first_day_of_month(value: ColumnLike) -> Column:
    """Midnight of the first day."""
    return F.date_trunc("month", col(value)).cast("timestamp_ntz")


def last_day_of_month(value: ColumnLike) -> Column:
    return F.last_day(col(value))
