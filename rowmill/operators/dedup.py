"""Duplicate removal, first rows per group, and gap-free numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.ordered import HOT_ROWS, first_of_groups, order_columns, ordered_slices, running_total, split_hot, task_groups, tie_break, with_position

def first_rows(
    df: DataFrame, n: int, keys: Sequence[str], order: Sequence, ignore_case: Sequence[str] = (),
    tie: Sequence[str] | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """First ``n`` rows of each key in ``order``; ``tie`` decides among equal rows as in ``tie_break``.

    Each task keeps at most ``n`` rows per key before the shuffle (``n`` up to 1,000). Where those of all tasks may be more than
    ``hot_rows``, the first ``n`` are taken per key and group of tasks, then per key. Where even ``n`` rows per group are
    more, the ranks of keys with more than ``hot_rows`` rows come from a sorted copy. So no task sees more than about
    ``hot_rows`` rows of a key for any ``n``, and the rows kept are the same.
    """
    parts = [F.lower(k) if k in ignore_case else F.col(k) for k in keys]
    groups = [f"_g{i}" for i in range(len(parts))]
    grouped = df.select("*", *[p.alias(g) for p, g in zip(parts, groups)], tie_break(df, tie).alias("_tie"))
    limit, ranked_by = HOT_ROWS if hot_rows is None else hot_rows, [*order_columns(order), F.col("_tie")]
    sets = task_groups(df.sparkSession, n, limit)
    few = n * sets <= limit
    if sets > 1 and few:
        grouped = first_of_groups(grouped, n, groups, ranked_by, sets)
    cool, hot = (grouped, None) if few else split_hot(grouped, groups, limit)
    window = Window.partitionBy(*groups).orderBy(*ranked_by)
    kept = cool.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).select(*df.columns)
    if hot is None:
        return kept
    ranked = running_total(ordered_slices(hot, [*groups, *order, "_tie"], tie), groups, F.lit(1), "_rank")
    return kept.unionAll(ranked.where(F.col("_rank") <= n).select(*df.columns))


def dedup(
    df: DataFrame, keys: Sequence[str], order: Sequence, case_sensitive: bool = True, tie: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the first in ``order``. Without case, text keys compare in lower case."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return first_rows(df, 1, keys, order, () if case_sensitive else [k for k in keys if k in text], tie)


def sequence(
    df: DataFrame, name: str, order: Sequence, start: int = 1, step: int = 1, tie: Sequence[str] | None = None
) -> DataFrame:
    """Number rows ``start, start+step, ...`` in ``order``."""
    return with_position(df, order, name, start, step, tie)


def sequence_within(
    df: DataFrame, name: str, keys: Sequence[str], order: Sequence, tie: Sequence[str] | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Number the rows of each key 1, 2, ... also where one key holds a large share of the rows."""
    marked = df.withColumn("_tie", tie_break(df, tie))
    cool, hot = split_hot(marked, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*order_columns(order), "_tie")
    numbered = cool.withColumn(name, F.row_number().over(window).cast("bigint")).select(*df.columns, name)
    if hot is None:
        return numbered
    ranked = running_total(ordered_slices(hot, [*keys, *order, "_tie"], tie), keys, F.lit(1).cast("bigint"), name)
    return numbered.unionAll(ranked.select(*df.columns, name))
