"""Grouped aggregation, exact medians, denormalising and row meters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rowmill.operators.ordered import POS, SLICE, ordered_slices, sort_key, split_hot
from rowmill.session import materialize

Operation = tuple[str, str, str]  # (input column, function, output column)


def _ordering(column: str, order_by: Sequence[str] | None, function: str) -> Column:
    if not order_by:
        raise ValueError(f"{function} needs order_by")
    return sort_key(order_by, F.col(column).isNull(), F.col(column))


def _listed(column: str, order_by: Sequence[str] | None, separator: str) -> Column:
    # As ``sort_key``, the item's own text last; without an order the value itself comes first and is never NULL here.
    order = [p for c in order_by for p in (F.col(c).isNull(), F.col(c))] if order_by else [F.col(column)]
    items = F.struct(*[p.alias(f"k{i}") for i, p in enumerate(order)], F.col(column).cast("string").alias("_item"))
    # collect_list skips NULL structs, as a text list skips NULL values.
    kept = F.collect_list(F.when(F.col(column).isNotNull(), items))
    joined = F.array_join(F.transform(F.sort_array(kept), lambda s: s["_item"]), separator)
    return F.when(F.count(column) > 0, joined)


_PLAIN = {
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
    "count_distinct": F.count_distinct,
    "standard_deviation": F.stddev_samp,
}

# Further functions accepted by name.
_MORE = {
    "stddev": F.stddev_samp,
    "stddev_pop": F.stddev_pop,
    "variance": F.var_samp,
    "var_pop": F.var_pop,
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
    "skewness": F.skewness,
    "kurtosis": F.kurtosis,
}


def aggregate_column(column: str, function: str, order_by: Sequence[str] | None = None, separator: str = ",") -> Column:
    """The aggregate of one operation.

    ``list`` builds one text per group, so its cell grows with the group; no value at all gives NULL. ``first``,
    ``last`` and ``list`` take ``order_by`` with NULLs last; among rows equal in it the values themselves decide,
    the smallest first.
    """
    name = function.lower()
    if name in _PLAIN:
        return _PLAIN[name](column)
    if name in _MORE:
        return _MORE[name](column)
    if name == "first":
        return F.min_by(column, _ordering(column, order_by, name))
    if name == "last":
        return F.max_by(column, _ordering(column, order_by, name))
    if name == "list":
        return _listed(column, order_by, separator)
    raise ValueError(f"unknown aggregate {function!r}")


# Leading bits that a round of the selection settles; a round counts at most 2**16 numbers per group and task.
_ROUND_BITS = 16


def _ordered_bits(value: Column) -> Column:
    """The 64 bits of a double as a number that sorts like it: NaN last, both zeros equal."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit((1 << 63) - 1)))


def _from_bits(number: Column) -> Column:
    bits = number.bitwiseXOR(F.shiftright(number, 63).bitwiseAND(F.lit((1 << 63) - 1)))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _same(keys: Sequence[str], other: str = "_k_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys], F.lit(True))


def middle_by_bits(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Median of the double column ``value``, which has no NULLs, by radix selection; no row is sorted or shuffled.

    Each round counts the rows per next 16 leading bits, combined before the shuffle, and keeps the bits
    in which the middle ranks lie; the next round counts only rows that begin with them. What is known of a group is one
    row, or two where the middle ranks part, written after each round: it is joined to the rows by its measured size.
    """
    bits = rows.select(*keys, _ordered_bits(F.col(value)).alias("_bits"))
    state = None
    for shift in range(64 - _ROUND_BITS, -1, -_ROUND_BITS):
        found = bits.withColumn("_next", F.shiftright(F.col("_bits"), shift))
        if state is None:
            counts = found.groupBy(*keys, "_next").agg(F.count("*").alias("_n"))
            group = [*keys]
        else:
            known = state.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_lead", "_ranks")
            found = found.withColumn("_begins", F.shiftright(F.col("_bits"), shift + _ROUND_BITS))
            met = found.join(known, _same(keys) & (F.col("_begins") == F.col("_lead")))
            counts = met.groupBy(*keys, "_lead", "_ranks", "_next").agg(F.count("*").alias("_n"))
            group = [*keys, "_lead"]
        upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_next")) - F.col("_n")
        counts = counts.withColumn("_before", upto)
        if state is None:
            size = F.sum("_n").over(Window.partitionBy(*group))
            counts = counts.withColumn("_size", size).withColumn(
                "_ranks", F.array(F.floor((F.col("_size") + 1) / 2), F.floor((F.col("_size") + 2) / 2))
            )
        inside = F.filter("_ranks", lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_n")))
        state = counts.select(
            *keys, F.col("_next").alias("_lead"), F.transform(inside, lambda r: r - F.col("_before")).alias("_ranks")
        ).where(F.size("_ranks") > 0)
        state = materialize(state, "bits")
    halves = state.select(*keys, (_from_bits(F.col("_lead")) * (F.size("_ranks") / 2)).alias("_half"))
    return halves.groupBy(*keys).agg(F.sum("_half").alias(name))


def exact_median(df: DataFrame, keys: Sequence[str], column: str, name: str = "median", hot_rows: int | None = None) -> DataFrame:
    """Median of a numeric column per group, exact for groups of any size.

    Ordinary groups use the built-in function, large ones ``middle_by_bits``. NULLs do not count; a group without a
    value has no row.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_value"))
    cool, hot = split_hot(rows, keys, hot_rows)
    plain = cool.groupBy(*keys).agg(F.median("_value").alias(name)) if keys else None
    if hot is None:
        return plain
    middle = middle_by_bits(hot, keys, "_value", name)
    return plain.unionByName(middle) if keys else middle


def whole_list(
    df: DataFrame, keys: Sequence[str], column: str, name: str, separator: str = ",", order_by: Sequence[str] | None = None,
    hot_rows: int | None = None, all_keys: bool = False,
) -> DataFrame:
    """One text per group. Rows of large groups are gathered per (slice, group), and only the parts meet."""
    cool, hot = split_hot(df, keys, hot_rows, F.octet_length(F.col(column).cast("string")))
    plain = cool.groupBy(*keys).agg(_listed(column, order_by, separator).alias(name)) if keys else None
    if hot is None:
        return plain
    parts = _list_parts(hot, keys, column, separator, order_by)
    whole = F.transform(F.array_sort(F.collect_list(F.struct(SLICE, "_part"))), lambda p: p["_part"])
    joined = parts.groupBy(*keys).agg(F.array_join(whole, separator).alias(name))
    if keys and all_keys:
        # Keys without any value have no part; a row per task and key is enough to name them.
        blank = hot.groupBy(*keys).agg(F.count(column).alias("_n")).where("_n = 0").select(*keys, F.lit(None).cast("string").alias(name))
        joined = joined.unionByName(blank)
    return plain.unionByName(joined) if keys else joined


def _list_parts(df: DataFrame, keys: Sequence[str], column: str, separator: str, order_by: Sequence[str] | None) -> DataFrame:
    order = list(order_by or [column])
    # A random number keeps copies of a value apart, so that they spread over slices; which copy is which is not seen.
    rows = df.select(*keys, *[c for c in dict.fromkeys([*order, column]) if c not in keys], F.col(column).cast("string").alias("_text"))
    rows = rows.where(F.col(column).isNotNull()).withColumn("_copy", F.rand(17))
    sliced = ordered_slices(rows, [*keys, *order, "_text"], ["_copy"])
    return sliced.groupBy(SLICE, *keys).agg(_listed(column, [POS], separator).alias("_part"))


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    operations: Sequence[Operation],
    order_by: Sequence[str] | None = None,
    separator: str = ",",
    gather: str = "sliced",
    hot_rows: int | None = None,
) -> DataFrame:
    """Group by ``keys`` (none: one row) and apply ``(input, function, output)`` operations.

    Medians and lists need all values of a group. ``gather="sliced"`` finds groups too large for one task
    (above ``hot_rows`` rows) and computes those over a sorted copy; ``gather="memory"`` skips that check where
    groups are known to be small. The results are the same.
    """
    if gather not in ("sliced", "memory"):
        raise ValueError("gather is sliced or memory")
    whole = ("median", "list") if gather == "sliced" else ()
    direct = [(c, f.lower(), o) for c, f, o in operations if f.lower() not in whole]
    columns = [
        (F.median(c) if f == "median" else aggregate_column(c, f, order_by, separator)).alias(o) for c, f, o in direct
    ]
    gathered = [(c, f.lower(), o) for c, f, o in operations if f.lower() in whole]
    if keys and not columns and len(gathered) == 1 and gathered[0][1] == "list":
        # The list alone has a row for each key already.
        column, _, name = gathered[0]
        return whole_list(df, keys, column, name, separator, order_by, hot_rows, all_keys=True).select(*keys, name)
    if columns:
        out = df.groupBy(*keys).agg(*columns)
    else:
        out = df.select(*keys).distinct() if keys else df.groupBy().agg(F.count("*").alias("_n")).drop("_n")
    for column, function, name in gathered:
        if function == "median":
            side = exact_median(df, keys, column, name, hot_rows)
        else:
            side = whole_list(df, keys, column, name, separator, order_by, hot_rows)
        if keys:
            side = side.select(*[F.col(k).alias(f"_k_{k}") for k in keys], name)
            match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
            out = out.join(side, match, "left").drop(*[f"_k_{k}" for k in keys])
        else:
            out = out.withColumn(name, side.scalar())
    return out.select(*keys, *[o for _, _, o in operations])


def aggregate_sorted(df: DataFrame, keys: Sequence[str], operations: Sequence[Operation], **options) -> DataFrame:
    """Aggregate rows that arrive sorted. The sort is not needed here, so the result and plan are the same."""
    return aggregate(df, keys, operations, **options)


def denormalize(
    df: DataFrame, keys: Sequence[str], column: str, separator: str = ",", dedup: bool = False,
    order_by: Sequence[str] | None = None, gather: str = "sliced", hot_rows: int | None = None,
) -> DataFrame:
    """One delimited text per key. With ``dedup`` equal values are removed before rows are gathered."""
    if dedup:
        df = df.select(*keys, column).distinct()
        order_by = None
    return aggregate(df, keys, [(column, "list", column)], order_by, separator, gather, hot_rows)


def denormalize_parts(
    df: DataFrame, keys: Sequence[str], column: str, separator: str = ",", order_by: Sequence[str] | None = None
) -> DataFrame:
    """As ``denormalize`` for keys whose text is too large for one cell: numbered parts that join to the whole.

    A key is cut where the sorted table is cut, so a part is never larger than one slice.
    """
    parts = _list_parts(df, keys, column, separator, order_by).withColumnRenamed("_part", column)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(SLICE))
    return parts.withColumn("part", number).select(*keys, "part", column)


def flow_meter(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Count rows as they flow through, without an extra pass.

    Read the count with ``observation.get[name]`` after an action on the returned DataFrame.
    """
    observation = Observation(f"meter_{name}")
    return df.observe(observation, F.count(F.lit(1)).alias(name)), observation
