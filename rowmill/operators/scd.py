"""Slowly changing dimensions, surrogate keys and change application."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.ordered import neighbour, order_columns, ordered_slices, row_hash, sort_key, split_hot, with_position
from rowmill.session import materialize


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns], F.lit(True)
    )


def _paired(dim: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dimension and update rows side by side as structs ``d`` and ``u``; either may be NULL.

    A key has at most one row on each side, so no key is larger than two rows here.
    """
    d = dim.select(*[F.col(k).alias(f"_d{i}") for i, k in enumerate(keys)], F.struct(*dim.columns).alias("d"))
    u = updates.select(*[F.col(k).alias(f"_u{i}") for i, k in enumerate(keys)], F.struct(*updates.columns).alias("u"))
    cond = reduce(lambda a, b: a & b, [F.col(f"_d{i}") == F.col(f"_u{i}") for i in range(len(keys))])
    return d.join(u, cond, "full").select("d", "u")


def _one_update(updates: DataFrame, keys: Sequence[str], order: Sequence[str] | None) -> DataFrame:
    """One update per key: the last in ``order``; without an order a key with several updates fails the job."""
    if order is not None:
        return latest_changes(updates, keys, order)
    names = [f"_k{i}" for i in range(len(keys))]
    row = F.any_value(F.struct(*updates.columns)).alias("_row")
    single = updates.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count("*").alias("_n"), row)
    text = F.concat(F.lit("several updates of key "), F.to_json(F.struct(*names)), F.lit(": give an order"))
    return single.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))).select("_row.*")


def scd1(
    dim: DataFrame, updates: DataFrame, keys: Sequence[str], tracked: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Overwrite tracked columns of known keys and insert new keys.

    Keys are unique in the dimension. Of several updates of a key the last in ``order`` counts; without it they fail.
    """
    paired = _paired(dim, _one_update(updates, keys, order), keys)
    given = set(updates.columns)
    known, updated = F.col("d").isNotNull(), F.col("u").isNotNull()
    out = []
    for c in dim.columns:
        old, new = F.col(f"d.{c}"), F.col(f"u.{c}") if c in given else F.lit(None)
        taken = (updated if c in tracked else updated & ~known) if c in given else F.lit(False)
        out.append(F.when(taken, new).otherwise(old).alias(c))
    return paired.select(*out)


def assign_keys(new_rows: DataFrame, dim: DataFrame, key: str, order: Sequence) -> DataFrame:
    """Give rows the next surrogate keys after the largest one of the dimension, in ``order``."""
    base = new_rows.drop(key)
    numbered = with_position(base, order, "_n")
    top = dim.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("m")).scalar()
    return numbered.withColumn(key, top + F.col("_n")).drop("_n").select(key, *base.columns)


def scd2(
    dim: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    as_of: Column,
    start: str = "valid_from",
    end: str = "valid_to",
    current: str = "is_current",
    surrogate: str | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Close changed versions, add new versions, keep history.

    Only current versions meet the updates; closed history passes through without a shuffle.
    Of several updates of a key the last in ``order`` counts; without it they fail. ``as_of`` ends closed
    versions and starts new ones.
    """
    now = _paired(dim.where(F.col(current)), _one_update(updates, keys, order), keys)
    known, updated = F.col("d").isNotNull(), F.col("u").isNotNull()
    changed = known & updated & ~_same("d", "u", tracked)
    types = {f.name: f.dataType for f in dim.schema.fields}
    given = set(updates.columns)

    kept, fresh = [], []
    for c in dim.columns:
        old = F.col(f"d.{c}")
        if c == end:
            kept.append(F.when(changed, as_of).otherwise(old).cast(types[c]).alias(c))
            fresh.append(F.lit(None).cast(types[c]).alias(c))
        elif c == current:
            kept.append((old & ~changed).alias(c))
            fresh.append(F.lit(True).alias(c))
        elif c == start:
            kept.append(old.alias(c))
            fresh.append(as_of.cast(types[c]).alias(c))
        elif c == surrogate:
            kept.append(old.alias(c))
            fresh.append(F.lit(None).cast(types[c]).alias(c))
        else:
            kept.append(old.alias(c))
            # A new version takes what the update gives and inherits the rest.
            value = F.when(updated & F.lit(c in tracked or c in keys), F.col(f"u.{c}")) if c in given else F.lit(None)
            inherit = old if c not in tracked and c not in keys else F.lit(None)
            first = F.when(~known, F.col(f"u.{c}")) if c in given else F.lit(None)
            fresh.append(F.coalesce(value, first, inherit).cast(types[c]).alias(c))

    versions = F.filter(
        F.array(
            F.when(known, F.struct(*kept)),
            F.when(changed | ~known, F.struct(*fresh)),
        ),
        lambda v: v.isNotNull(),
    )
    # The outer form computes the versions once; there is always one.
    open_rows = now.select(F.inline_outer(versions))
    history = dim.where(~F.coalesce(F.col(current), F.lit(False))).select(*dim.columns)
    if surrogate is None:
        return history.unionAll(open_rows)
    # Read three times below: by the numbering, by its sort and by the result.
    open_rows = materialize(open_rows, "versions")
    added = assign_keys(open_rows.where(F.col(surrogate).isNull()), dim, surrogate, [*keys, start])
    return history.unionAll(open_rows.where(F.col(surrogate).isNotNull())).unionByName(added)


def read_change_feed(
    df: DataFrame, op_column: str, codes: Mapping[str, Sequence[str]] | None = None, name: str = "change"
) -> DataFrame:
    """Normalise operation codes to ``insert``, ``update`` and ``delete``; other codes give NULL."""
    codes = codes or {"insert": ["I", "C", "INSERT"], "update": ["U", "UPDATE"], "delete": ["D", "DELETE"]}
    value = F.upper(F.trim(F.col(op_column)))
    out = F.lit(None).cast("string")
    for change, spellings in codes.items():
        out = F.when(value.isin([s.upper() for s in spellings]), change).otherwise(out)
    return df.withColumn(name, out)


def latest_changes(changes: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """The last change of each key, in an order with NULLs last; a row hash decides among equal ones.

    The partial maximum leaves one row per key and task to shuffle.
    """
    row = F.struct(*changes.columns)
    best = changes.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(row, sort_key(sequence, row_hash(changes))).alias("_row")
    )
    return best.select("_row.*")


def apply_changes(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: Sequence[str], change: str = "change"
) -> DataFrame:
    """Apply the latest insert, update or delete of each key to ``base``."""
    paired = _paired(base, latest_changes(changes, keys, sequence), keys)
    deleted = F.coalesce(F.col(f"u.{change}") == "delete", F.lit(False))
    updated = F.col("u").isNotNull()
    given = set(changes.columns)
    cells = [
        (F.when(updated, F.col(f"u.{c}")).otherwise(F.col(f"d.{c}")) if c in given else F.col(f"d.{c}")).alias(c)
        for c in base.columns
    ]
    return paired.where(~deleted).select(*cells)


def history_from_log(
    log: DataFrame, keys: Sequence[str], ts: str, tracked: Sequence[str], order: Sequence[str] = (),
    start: str = "valid_from", end: str = "valid_to", current: str = "is_current", hot_rows: int | None = None,
) -> DataFrame:
    """Validity intervals from an event log: one row per run of equal tracked values of a key.

    Ordinary keys use windows. Keys with a long log go over a sorted copy, spread over many tasks.
    """
    columns = list(dict.fromkeys([*keys, ts, *order, *tracked]))
    # The hash of the whole row orders entries of one moment and keeps them apart.
    rows = log.select(*columns, row_hash(log).alias("_tie"))
    seen = F.struct(F.lit(1).alias("_seen"), *tracked)
    moment = F.struct(F.col(ts).alias("t"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_before.{c}")) for c in tracked])
    changed = F.col("_before").isNull() | ~same

    cool, hot = split_hot(rows, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*order_columns([ts, *order, "_tie"]))
    starts = cool.withColumn("_before", F.lag(seen).over(window)).where(changed)
    bounded = starts.withColumn("_after", F.lead(moment).over(window))
    cells = [
        *keys, *tracked, F.col(ts).alias(start), F.col("_after.t").alias(end), F.col("_after").isNull().alias(current)
    ]
    if hot is None:
        return bounded.select(*cells)
    sliced = ordered_slices(hot, [*keys, ts, *order, "_tie"])
    starts = neighbour(sliced, keys, seen, "_before").where(changed)
    return bounded.select(*cells).unionAll(neighbour(starts, keys, moment, "_after", forward=True).select(*cells))
