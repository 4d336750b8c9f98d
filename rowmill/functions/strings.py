"""Text. Positions count from 0; a missing text has position -1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions import ColumnLike, arg, col


def upcase(text: ColumnLike) -> Column:
    return F.upper(col(text))


def downcase(text: ColumnLike) -> Column:
    return F.lower(col(text))


def trim(text: ColumnLike) -> Column:
    return F.trim(col(text))


def ltrim(text: ColumnLike) -> Column:
    return F.ltrim(col(text))


def rtrim(text: ColumnLike) -> Column:
    return F.rtrim(col(text))


def length(text: ColumnLike) -> Column:
    return F.length(col(text))


def left(text: ColumnLike, n: int | Column) -> Column:
    return F.left(col(text), arg(n))


def right(text: ColumnLike, n: int | Column) -> Column:
    return F.right(col(text), arg(n))


def substr(text: ColumnLike, start: int | Column, n: int | Column) -> Column:
    """``n`` characters from 0-based ``start``."""
    return F.substring(col(text), arg(start) + 1, arg(n))


def substring(text: ColumnLike, start: int, end: int | None = None) -> Column:
    """Characters from ``start`` up to ``end`` (not included) or to the end."""
    size = F.length(col(text)) if end is None else F.lit(end - start)
    return F.substring(col(text), F.lit(start + 1), size)


def index(text: ColumnLike, search: str | Column) -> Column:
    """0-based position, -1 when absent."""
    return F.locate(search, col(text)) - 1 if isinstance(search, str) else F.position(search, col(text)) - 1


def change(text: ColumnLike, search: str | Column, replacement: str | Column) -> Column:
    """Replace every occurrence of plain text."""
    return F.replace(col(text), arg(search), arg(replacement))


def ereplace(text: ColumnLike, pattern: str | Column, replacement: str | Column) -> Column:
    """Replace every match of a pattern; groups are ``$1``."""
    return F.regexp_replace(col(text), arg(pattern), arg(replacement))


replace_all = ereplace


def count_of(text: ColumnLike, search: str | Column) -> Column:
    """Occurrences of plain text, without overlaps; NULL for an empty search."""
    source, part = col(text), arg(search)
    gone = F.length(source) - F.length(F.replace(source, part, F.lit("")))
    return F.try_divide(gone, F.length(part)).cast("bigint")


def lpad(text: ColumnLike, n: int, pad: str = " ") -> Column:
    return F.lpad(col(text), n, pad)


def rpad(text: ColumnLike, n: int, pad: str = " ") -> Column:
    return F.rpad(col(text), n, pad)


def is_alpha(text: ColumnLike) -> Column:
    """Only letters a-z and A-Z, at least one."""
    return col(text).rlike(r"^[a-zA-Z]+\z")


def space(n: int | Column) -> Column:
    return F.repeat(F.lit(" "), arg(n))


def dquote(text: ColumnLike) -> Column:
    return F.concat(F.lit('"'), col(text), F.lit('"'))


def squote(text: ColumnLike) -> Column:
    return F.concat(F.lit("'"), col(text), F.lit("'"))


def quote_sql_list(text: ColumnLike) -> Column:
    """``a,b`` to ``'a','b'``."""
    return squote(F.replace(col(text), F.lit(","), F.lit("','")))


def is_empty(text: ColumnLike) -> Column:
    """NULL or the empty text."""
    return col(text).isNull() | (col(text) == "")


def is_not_empty(text: ColumnLike) -> Column:
    return col(text).isNotNull() & (col(text) != "")


def matches(text: ColumnLike, pattern: str) -> Column:
    """Whether the whole text matches."""
    return col(text).rlike(rf"^(?:{pattern})\z")


def search(text: ColumnLike, pattern: str) -> Column:
    """Whether some part of the text matches."""
    return col(text).rlike(pattern)


def starts_with(text: ColumnLike, part: str | Column) -> Column:
    return F.startswith(col(text), arg(part))


def ends_with(text: ColumnLike, part: str | Column) -> Column:
    return F.endswith(col(text), arg(part))


def contains(text: ColumnLike, part: str | Column) -> Column:
    return F.contains(col(text), arg(part))


def equals(left_text: ColumnLike, other: str | Column) -> Column:
    return col(left_text) == arg(other)


def equals_ignore_case(left_text: ColumnLike, other: str | Column) -> Column:
    return F.lower(col(left_text)) == F.lower(arg(other))


def concat(*parts: str | Column) -> Column:
    """Join texts; NULL when one is NULL. Plain strings are literals."""
    return F.concat(*[arg(p) for p in parts])
