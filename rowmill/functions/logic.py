"""Tests, choices and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions import ColumnLike, arg, col


def is_null(x: ColumnLike) -> Column:
    return col(x).isNull()


def is_not_null(x: ColumnLike) -> Column:
    return col(x).isNotNull()


def negate(test: ColumnLike) -> Column:
    return ~col(test)


def choose(test: Column, then, otherwise) -> Column:
    """``test ? then : otherwise``; nests to any depth. A NULL test chooses ``otherwise``."""
    return F.when(test, arg(then)).otherwise(arg(otherwise))


def nvl(x: ColumnLike, *defaults) -> Column:
    """The first value that is not NULL."""
    return F.coalesce(col(x), *[arg(d) for d in defaults])


ifnull = nvl
