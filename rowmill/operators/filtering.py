"""Row filters with reject flows, sampling, sort and limit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.operators import Split
from rowmill.operators.ordered import first_of_groups, order_columns, task_groups, tie_break, with_position
from rowmill.operators.positions import MAX_RANGES, comparable, rows_between

Condition = tuple[str, str, Any]

_TESTS = {
    "==": lambda c, v: c == F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "MATCHES": lambda c, v: c.rlike(f"^(?:{v})\\z"),
    "SEARCH": lambda c, v: c.rlike(v),
    "CONTAINS": lambda c, v: c.contains(v),
    "STARTS_WITH": lambda c, v: c.startswith(v),
    "ENDS_WITH": lambda c, v: c.endswith(v),
    "IN": lambda c, v: c.isin(list(v)),
    "IS_NULL": lambda c, v: c.isNull(),
    "IS_NOT_NULL": lambda c, v: c.isNotNull(),
}


def predicate(conditions: Sequence[Condition], logic: str = "AND") -> Column:
    """One Column from ``(column, operator, value)`` conditions joined by AND or OR."""
    logic = logic.upper()
    if logic not in ("AND", "OR"):
        raise ValueError(f"logic must be AND or OR, not {logic!r}")
    tests = []
    for name, operator, value in conditions:
        test = _TESTS.get(operator.upper())
        if test is None:
            raise ValueError(f"unknown operator {operator!r}; known: {', '.join(_TESTS)}")
        tests.append(test(F.col(name), value))
    if not tests:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if logic == "AND" else (lambda a, b: a | b), tests)


def filter_rows(df: DataFrame, conditions: Sequence[Condition], logic: str = "AND") -> DataFrame:
    """Rows that meet the conditions; plain predicates, so they reach the scan."""
    return df.where(predicate(conditions, logic))


def split_rows(df: DataFrame, conditions: Sequence[Condition] | Column, logic: str = "AND") -> Split:
    """Rows that meet the conditions, and all the others (also where the test is NULL)."""
    test = conditions if isinstance(conditions, Column) else predicate(conditions, logic)
    return Split(df.where(test), df.where(~F.coalesce(test, F.lit(False))))


def sort_rows(df: DataFrame, order: Sequence, tie: Sequence[str] | None = None) -> DataFrame:
    """Global sort, NULLs last. Rows with equal keys are ordered by ``tie_break``, so one sort value
    that holds a large share of the rows still spreads over several range partitions."""
    return df.orderBy(*order_columns(order), tie_break(df, tie))


# Up to this n Spark keeps the first n rows of each task before a shuffle; beyond it a top-n is cut from the sorted table.
TOP_ROWS = 1_000


def limit_rows(
    df: DataFrame, n: int, order: Sequence | None = None, tie: Sequence[str] | None = None, hot_rows: int | None = None
) -> DataFrame:
    """First ``n`` rows, in ``order`` when given, equal ones decided by ``tie_break``; without an order any ``n`` rows.

    Each task keeps ``n`` rows. Where those of all tasks may be more than ``hot_rows``, the first ``n`` are taken per group of
    tasks and then of the groups. The rows are the same for any setting.
    """
    if not order:
        return df.limit(n)
    if n > TOP_ROWS:
        return with_position(df, order, "_position", tie=tie).where(F.col("_position") <= n).drop("_position")
    sets = task_groups(df.sparkSession, n, hot_rows)
    ranked_by = [*order_columns(order), F.col("_tie")]
    marked = df.withColumn("_tie", tie_break(df, tie))
    kept = first_of_groups(marked, n, [], ranked_by, sets) if sets > 1 else marked
    return kept.orderBy(*ranked_by).limit(n).select(*df.columns)


def sample_rows(
    df: DataFrame,
    order: Sequence,
    ranges: Sequence[tuple[int, int]] | None = None,
    every_nth: int | None = None,
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """Rows at listed 1-based position ranges, or every Nth row, of the table in ``order``.

    Ranges are found by ``rows_between``, without sorting the table, where it can compare the order columns. Every Nth
    row needs the position of each, so that the table is sorted. Positions outside the table have no row.
    """
    if not ranges and not every_nth:
        raise ValueError("give ranges or every_nth")
    if ranges and len(ranges) <= MAX_RANGES and comparable(df, order):
        return rows_between(df, order, ranges, tie)
    numbered = with_position(df, order, "_position", tie=tie)
    if ranges:
        keep = reduce(lambda a, b: a | b, [F.col("_position").between(lo, hi) for lo, hi in ranges])
    else:
        keep = F.col("_position") % every_nth == 0
    return numbered.where(keep).drop("_position")
