"""User code over rows: expressions first, Arrow batches where expressions do not reach."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowmill.operators.mapping import Expression, as_column


def custom_rows(df: DataFrame, assignments: Mapping[str, Expression]) -> DataFrame:
    """Assignments ``output = expression(input)`` in order; a later one sees an earlier one."""
    for name, expression in assignments.items():
        df = df.withColumn(name, as_column(expression))
    return df


def custom_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    begin: Callable[[], object] | None = None,
    end: Callable[[object], pd.DataFrame | None] | None = None,
) -> DataFrame:
    """Run ``fn`` on Arrow batches.

    ``begin`` runs once per task and its result is the second argument of ``fn``; ``end`` may give
    a last batch of the task.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        state = begin() if begin else None
        for batch in batches:
            yield fn(batch, state) if begin else fn(batch)
        last = end(state) if end else None
        if last is not None:
            yield last

    return df.mapInPandas(run, schema)


def custom_table(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Rows to any number of rows, batch by batch."""
    return df.mapInPandas(lambda batches: (fn(batch) for batch in batches), schema)
