"""Scalar functions as ``Column -> Column`` helpers, all built from JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    """A column by name, or the Column itself."""
    return F.col(value) if isinstance(value, str) else value


def arg(value) -> Column:
    """A literal argument, or the Column itself."""
    return value if isinstance(value, Column) else F.lit(value)
