"""Rows to columns, columns to rows, lists to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, items: Column, name: str, keep_empty: bool = False) -> DataFrame:
    """One row per item of a computed list, in a new or existing column.

    A plain ``explode`` lets Spark add filters that compute the list again; the outer form does not.
    """
    kept = [c for c in df.columns if c != name]
    out = df.select(*[F.col(f"`{c}`") for c in kept], F.posexplode_outer(items).alias("_item_no", name))
    if not keep_empty:
        out = out.where(F.col("_item_no").isNotNull())
    order = df.columns if name in df.columns else [*df.columns, name]
    return out.select(*[F.col(f"`{c}`") for c in order])


def normalize(
    df: DataFrame, column: str, separator: str = ",", trim: bool = True, drop_empty: bool = False,
    regex: bool = False, keep_null: bool = False,
) -> DataFrame:
    """One row per item of a delimited field. A NULL field gives no row unless ``keep_null``."""
    pattern = separator if regex else r"\Q" + separator + r"\E"
    items = F.split(F.col(column), pattern)
    if trim:
        items = F.transform(items, lambda item: F.trim(item))
    if drop_empty:
        items = F.filter(items, lambda x: x != "")
    return explode_rows(df, items, column, keep_null)


def array_flatten(df: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """One row per element of a list column."""
    return explode_rows(df, F.col(column), column, keep_empty)


_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def pivot(
    df: DataFrame, keys: Sequence[str], pivot_column: str, value_column: str, agg: str,
    values: Mapping[object, str] | Sequence[object],
) -> DataFrame:
    """One column per listed pivot value, as conditional aggregates: a single partial aggregation and shuffle."""
    names = values if isinstance(values, Mapping) else {v: str(v) for v in values}
    fn = _AGG[agg.lower()]
    cells = [
        fn(F.when(F.col(pivot_column).eqNullSafe(F.lit(v)), F.col(value_column))).alias(n) for v, n in names.items()
    ]
    return df.groupBy(*keys).agg(*cells)


def unpivot(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "pivot_key", value: str = "pivot_value"
) -> DataFrame:
    """One row per listed column, with its name and value."""
    return df.unpivot(list(ids), list(columns), name, value)
