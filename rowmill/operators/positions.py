"""Rows at given positions of an order, found by counting between bounds instead of sorting the table.

A bounded sample of the order's values gives bounds; one pass counts the rows between them. Rows between two bounds whose
positions are all wanted are part of the result as they are, those with none are left out, and only where a wanted range
begins or ends inside are further bounds drawn. Once these hold few rows, they are sorted and numbered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.operators import ordered
from rowmill.operators.ordered import order_columns, tie_break, with_position

BOUNDS = 24  # drawn in a round; each is a comparison in the generated code
_PER_BOUND = 40  # sample rows for each, so that bounds lie about evenly
MAX_RANGES = 16  # each may need two more bounds kept; more ranges go over the sorted table
_ROUNDS = 12
_TIE = "_tie"


def comparable(df: DataFrame, order: Sequence) -> bool:
    """Whether ``rows_between`` can compare the columns of ``order`` with literals."""
    plain = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [i if isinstance(i, str) else i[0] for i in order if not isinstance(i, Column)]
    return len(names) == len(order) and all(isinstance(kinds.get(n), plain) for n in names)


@dataclass
class _Order:
    """The columns of an order with their types, the tie last."""

    columns: list[tuple[str, bool, T.DataType]]

    def reaches(self, bound: Row) -> Column:
        """Whether a row is the bound or comes after it. NULLs come last, so a NULL is after any other value."""
        out = F.lit(True)
        for name, down, kind in reversed(self.columns):
            column, value = F.col(name), bound[name]
            if value is None:
                out = column.isNull() & out
                continue
            value = F.lit(value).cast(kind)
            later = column < value if down else column > value
            out = F.coalesce(later, F.lit(True)) | ((column == value) & out)
        return F.coalesce(out, F.lit(False))

    def place(self, bounds: list[Row]) -> Column:
        """Number of bounds that a row reaches; it never falls along the order, whatever the bounds are."""
        return reduce(lambda a, b: a + b, [self.reaches(b).cast("int") for b in bounds], F.lit(0))


def _wanted(first: int, last: int, ranges: list[tuple[int, int]]) -> str:
    """Whether none, all or some of the positions first..last lie in the ranges, which are merged and sorted."""
    for low, high in ranges:
        if low <= first and last <= high:
            return "all"
        if low <= last and first <= high:
            return "some"
    return "none"


def _merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(r for r in ranges if r[0] <= r[1]):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def rows_between(
    df: DataFrame, order: Sequence, ranges: Sequence[tuple[int, int]], tie: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose 1-based position in ``order`` (NULLs last, then ``tie_break``) lies in one of ``ranges``.

    Counts when it is called: one pass over the order columns, and one per round of bounds. At most ``BOUNDS`` *
    ``_PER_BOUND`` rows' order columns, about, come to the driver in a round. Nothing is written, and only the rows
    around the ends of the ranges are sorted. Rows that agree in every column are interchangeable. An empty table, or
    ranges beyond its end, give no rows.
    """
    merged = _merged(ranges)
    marked = df.withColumn(_TIE, tie_break(df, tie))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    named = [(i, "asc") if isinstance(i, str) else i for i in order]
    keys = _Order([*[(n, d.lower() == "desc", kinds[n]) for n, d in named], (_TIE, False, T.LongType())])
    names = [n for n, _, _ in keys.columns]
    ranked_by = [*order_columns(order), F.col(_TIE)]
    total = df.count()
    if not merged or not total or merged[0][0] > total:
        return df.limit(0)

    bounds: list[Row] = []
    # (place, rows before it, its rows) of the stretches between bounds in which a range begins or ends.
    ends = [(0, 0, total)]
    whole: list[int] = []
    for _ in range(_ROUNDS):
        inside = sum(n for _, _, n in ends)
        if inside <= ordered.HOT_ROWS:
            break
        rows = marked.select(*names)
        if bounds:
            rows = rows.where(keys.place(bounds).isin([p for p, _, _ in ends]))
        share = min(1.0, BOUNDS * _PER_BOUND / inside)
        drawn = rows.sample(fraction=share, seed=7) if share < 1 else rows
        # Of the bounds so far, those around open stretches and at the ends of wanted runs stay.
        near = {i for p in [*(p for p, _, _ in ends), *_edges(whole)] for i in (p - 1, p)}
        kept = [b for i, b in enumerate(bounds) if i in near]
        fresh = drawn.withColumn("_old", F.lit(False))
        old = marked.sparkSession.createDataFrame([(*b, True) for b in kept], fresh.schema)
        found = fresh.unionByName(old).orderBy(*ranked_by, "_old").collect()
        step = max(1, (len(found) - len(kept)) // BOUNDS)
        tried = _distinct([b for i, b in enumerate(found) if b["_old"] or i % step == step // 2])
        tried = [Row(**{n: b[n] for n in names}) for b in tried]
        counts = dict(marked.groupBy(keys.place(tried).alias("_place")).count().collect())
        sizes = [counts.get(p, 0) for p in range(len(tried) + 1)]
        before = [0, *accumulate(sizes)]
        judged = [(p, before[p], n, _wanted(before[p] + 1, before[p] + n, merged)) for p, n in enumerate(sizes) if n]
        ends = [(p, b, n) for p, b, n, w in judged if w == "some"]
        bounds, whole = tried, [p for p, _, _, w in judged if w == "all"]
        if sum(n for _, _, n in ends) >= inside:
            break  # rows that no bound parts; they are numbered over the sorted rows of their stretch

    located = marked.withColumn("_place", keys.place(bounds)) if bounds else marked.withColumn("_place", F.lit(0))
    out = located.where(F.col("_place").isin(whole)).select(*df.columns) if whole else df.limit(0)
    small = {p: b for p, b, n in ends if n <= ordered.HOT_ROWS}
    if small:
        offset = F.create_map(*[x for p, b in small.items() for x in (F.lit(p), F.lit(b).cast("bigint"))])
        number = F.row_number().over(Window.partitionBy("_place").orderBy(*ranked_by)) + offset[F.col("_place")]
        numbered = located.where(F.col("_place").isin(list(small))).withColumn("_position", number)
        out = out.unionByName(numbered.where(_in_ranges(merged)).select(*df.columns))
    for place, rows_before, size in ends:
        if size > ordered.HOT_ROWS:
            part = located.where(F.col("_place") == place).select(*df.columns)
            numbered = with_position(part, order, "_position", rows_before + 1, tie=tie)
            out = out.unionByName(numbered.where(_in_ranges(merged)).select(*df.columns))
    return out


def _in_ranges(ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [F.col("_position").between(low, high) for low, high in ranges])


def _distinct(bounds: list[Row]) -> list[Row]:
    """Sorted bounds without the neighbours that are equal to the one before."""
    return [b for i, b in enumerate(bounds) if not i or b[:-1] != bounds[i - 1][:-1]]


def _edges(places: list[int]) -> list[int]:
    """The first and last of each run of neighbouring places."""
    held = set(places)
    return [p for p in places if p - 1 not in held or p + 1 not in held]
