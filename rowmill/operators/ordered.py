"""Exact work on ordered rows without one task per group.

``Window.partitionBy(key)`` sends every row of a key to one task, and a window without a key
sends the whole table there. The helpers below sort the table by range instead, so a hot key
spreads over many slices, and carry only one small row per (slice, key) across slice borders.
``split_hot`` finds the keys that need this; all others keep the plain window or aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.session import materialize

POS = "_pos"
SLICE = "_slice"
_BITS = 33  # monotonically_increasing_id keeps the task number above 33 bits of row number


def order_columns(order: Sequence) -> list[Column]:
    """Sort columns with NULLs last: ``"a"``, ``("a", "desc")`` or a ready Column."""
    out = []
    for item in order:
        if isinstance(item, Column):
            out.append(item)
            continue
        name, direction = (item, "asc") if isinstance(item, str) else item
        column = F.col(name)
        out.append(column.desc_nulls_last() if direction.lower() == "desc" else column.asc_nulls_last())
    return out


def reversed_columns(order: Sequence) -> list[Column]:
    """The exact reverse of ``order_columns`` for names and ``(name, direction)`` pairs."""
    out = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        column = F.col(name)
        out.append(column.asc_nulls_first() if direction.lower() == "desc" else column.desc_nulls_first())
    return out


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """Hash over the whole row: a deterministic tie break that also splits equal sort keys.

    Maps have no order of their own and stay out of the hash.
    """
    names = [f.name for f in df.schema.fields if not _has_map(f.dataType)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in names]) if names else F.lit(0).cast("bigint")


def tie_break(df: DataFrame, tie: Sequence[str] | None = None) -> Column:
    """What decides among rows that are equal in an order: a hash of the columns ``tie``, of all columns when None.

    Give the columns that make the order unique (none, when it already is) to keep scans from reading all columns.
    """
    if tie is None:
        return row_hash(df)
    return F.xxhash64(*[F.col(f"`{c}`") for c in tie]) if tie else F.lit(0).cast("bigint")


def sort_key(order: Sequence[str], *last: Column) -> Column:
    """A struct that compares like ``order`` with NULLs last, then like the columns ``last``."""
    parts = [p for c in order for p in (F.col(c).isNull(), F.col(c))]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate([*parts, *last])])


def ordered_slices(df: DataFrame, order: Sequence, tie: Sequence[str] | None = None) -> DataFrame:
    """Globally sorted copy of ``df`` with ``_slice`` (range partition) and ``_pos`` (total order).

    Slice numbers depend on sampled range bounds, so they are written out once; every later
    use, also after a lost executor, reads the same numbers. The copy is written when this is called.
    """
    ranked = df.orderBy(*order_columns(order), tie_break(df, tie))
    staged = materialize(ranked.withColumn(POS, F.monotonically_increasing_id()), "slices")
    return staged.withColumn(SLICE, F.shiftright(POS, _BITS))


# Groups up to this many rows and bytes of gathered values fit one task; larger ones go over slices. Both ways give the same rows.
HOT_ROWS = 250_000
HOT_BYTES = 64 << 20


def task_groups(spark: SparkSession, n: int, limit: int | None = None) -> int:
    """Groups of tasks between which a top-n is taken before the last one; 1 where a group step is not needed.

    Every task keeps n rows. With as many tasks as shuffle partitions, all of them together may be more rows than one
    task should see; the square root of the tasks as number of groups makes both steps about as large.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 if n * tasks <= (HOT_ROWS if limit is None else limit) else max(2, ceil(sqrt(tasks)))


def first_of_groups(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column], groups: int) -> DataFrame:
    """At most ``n`` rows of each key and group of tasks, among them the first ``n`` of each key.

    Which task a row is read by decides only where it is compared, not whether it is among the first.
    """
    window = Window.partitionBy(*keys, "_tasks").orderBy(*order)
    marked = df.withColumn("_tasks", F.pmod(F.spark_partition_id(), F.lit(groups)))
    return marked.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).select(*df.columns)


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int | None = None, size: Column | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of keys with more than ``limit`` rows (None when there are none).

    ``size``: bytes that a row adds to its group; groups above ``HOT_BYTES`` count as large, too. Counts per key
    first, when this is called: a pass over the key columns that is combined before its shuffle. Without keys the
    whole table is one group and counts as hot.
    """
    if not keys:
        return df.limit(0), df
    counts = df.groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(
        F.count("*").alias("_rows"), F.sum(F.lit(0) if size is None else size).alias("_bytes")
    )
    large = counts.where((F.col("_rows") > (HOT_ROWS if limit is None else limit)) | (F.col("_bytes") > HOT_BYTES))
    large = materialize(large.drop("_rows", "_bytes"), "hot")
    if large.isEmpty():
        return df, None
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])
    return df.join(large, match, "left_anti"), df.join(large, match, "left_semi")


def recomputed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows with keys Spark takes for new ones.

    A side that was grouped by its join key joins without a further shuffle, and then adaptive
    execution cannot split a hot key of the other side. With recomputed keys both sides are shuffled.
    """
    return df.withColumns({k: F.when(F.col(k).isNotNull(), F.col(k)) for k in keys})


def _slice_offsets(sliced: DataFrame) -> DataFrame:
    """Rows before each slice. One row per task of the sort, so its size is known and small."""
    spark = sliced.sparkSession
    sizes = sorted(sliced.groupBy(SLICE).count().collect())
    rows, before = [], 0
    for number, size in sizes:
        rows.append((number, before))
        before += size
    return spark.createDataFrame(rows, f"{SLICE} bigint, _before bigint")


def with_position(
    df: DataFrame, order: Sequence, name: str = "position", start: int = 1, step: int = 1, tie: Sequence[str] | None = None
) -> DataFrame:
    """Number all rows in ``order``: ``start, start+step, ...`` with no gaps. Sorts and counts when it is called."""
    sliced = ordered_slices(df, order, tie)
    offsets = F.broadcast(_slice_offsets(sliced))
    index = F.col("_before") + F.col(POS).bitwiseAND(F.lit((1 << _BITS) - 1))
    return (
        sliced.join(offsets, SLICE)
        .withColumn(name, F.lit(start).cast("bigint") + index * F.lit(step).cast("bigint"))
        .select(*df.columns, name)
    )


def _border_join(sliced: DataFrame, borders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach border rows to their (slice, key). Only keys that span slices have borders."""
    renamed = borders.select(
        F.col(SLICE).alias("_b_slice"), *[F.col(k).alias(f"_b_{k}") for k in keys], "_carry"
    )
    cond = F.col(SLICE) == F.col("_b_slice")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return sliced.join(renamed, cond, "left").drop("_b_slice", *[f"_b_{k}" for k in keys])


def neighbour(sliced: DataFrame, keys: Sequence[str], value: Column, name: str, forward: bool = False) -> DataFrame:
    """``lag`` (or ``lead`` when ``forward``) of ``value`` within a key.

    ``sliced`` comes from ``ordered_slices`` sorted by ``keys`` first; rows may have been filtered.
    """
    inside = Window.partitionBy(SLICE, *keys).orderBy(POS)
    across = Window.partitionBy(*keys).orderBy(SLICE)
    shift = F.lead if forward else F.lag
    edge = F.min_by if forward else F.max_by
    wrapped = F.struct(value.alias("v"))
    borders = (
        sliced.groupBy(SLICE, *keys)
        .agg(edge(wrapped, F.col(POS)).alias("_edge"))
        .withColumn("_carry", shift("_edge").over(across))
        .where(F.col("_carry").isNotNull())
    )
    local = sliced.withColumn("_near", shift(wrapped).over(inside))
    joined = _border_join(local, borders, keys)
    # The carry applies to the outermost row of the slice only, which has no local neighbour.
    found = F.coalesce(F.col("_near"), F.col("_carry"))
    return joined.withColumn(name, found["v"]).drop("_near", "_carry")


def running_total(sliced: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Exact running total of ``value`` per key, in slice order, including the current row."""
    inside = Window.partitionBy(SLICE, *keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        sliced.groupBy(SLICE, *keys)
        .agg(F.sum(value).alias("_part"))
        .withColumn("_carry", F.sum("_part").over(across))
        .where(F.col("_carry").isNotNull())
    )
    local = sliced.withColumn("_local", F.sum(value).over(inside))
    joined = _border_join(local, borders, keys)
    total = F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0))
    return joined.withColumn(name, total).drop("_local", "_carry")
