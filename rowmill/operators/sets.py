"""Unions and intersections of flows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def unite(flows: Sequence[DataFrame], by: str = "position") -> DataFrame:
    """All rows of all flows, matched by column position or by name (missing columns are NULL)."""
    if by == "position":
        return reduce(lambda a, b: a.unionAll(b), flows)
    if by == "name":
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flows)
    raise ValueError("by is position or name")


# Copies of one row that a task writes in one go.
COPIES = 100_000


def intersect(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    """Rows in both flows, NULLs equal; with ``all`` as many copies as the side with fewer has.

    One grouped union: equal rows collapse before the shuffle, where a semi join would send every
    copy of a frequent row to one task. Copies come back in blocks that spread over tasks.
    """
    names = left.columns
    both = left.withColumns({"_l": F.lit(1), "_r": F.lit(0)}).unionAll(right.withColumns({"_l": F.lit(0), "_r": F.lit(1)}))
    sides = both.groupBy(*names).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    shared = sides.select(*names, F.least("_l", "_r").alias("_n")).where(F.col("_n") > 0)
    if not all:
        return shared.drop("_n")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPIES).cast("bigint"))
    spread = shared.withColumn("_block", F.explode(blocks)).repartition(*names, "_block")
    left_over = F.least(F.col("_n") - F.col("_block") * COPIES, F.lit(COPIES).cast("bigint"))
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), left_over))).select(*names)


def replicate(df: DataFrame, n: int, keep: bool = False) -> list[DataFrame]:
    """The same rows for ``n`` consumers; ``keep`` stores them when they are costly to compute."""
    shared = df.persist(StorageLevel.MEMORY_AND_DISK) if keep else df
    return [shared] * n
