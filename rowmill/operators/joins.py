"""Lookups: equality joins on expressions, matching modes, rejects, fuzzy and address-range lookups.

Joins on keys carry no broadcast hint. Spark broadcasts a side only when its size is below
``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate, combinations, product
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.operators.mapping import Expression, as_column
from rowmill.operators.ordered import order_columns, ordered_slices, recomputed, reversed_columns, running_total, tie_break
from rowmill.session import materialize

_HOW = {
    "inner": "inner",
    "left": "left",
    "left_outer": "left",
    "right": "right",
    "right_outer": "right",
    "full": "full",
    "full_outer": "full",
    "cross": "cross",
}


def _condition(name: str, on: Mapping[str, Expression]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{name}.{k}") == as_column(e) for k, e in on.items()])


def one_per_key(
    ref: DataFrame, keys: Sequence[str], order: Sequence, last: bool = False, tie: Sequence[str] | None = None
) -> DataFrame:
    """The first (or last) row of each key; ``tie`` decides among equal rows as in ``tie_break``.

    The rank filter lets every task drop all but one row per key before the shuffle.
    """
    columns = reversed_columns(order) if last else order_columns(order)
    window = Window.partitionBy(*keys).orderBy(*columns, tie_break(ref, tie))
    return ref.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def lookup(
    main: DataFrame,
    ref: DataFrame,
    on: Mapping[str, Expression],
    how: str = "inner",
    match: str = "all",
    order: Sequence | None = None,
    name: str = "lookup",
    tie: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``main`` with ``ref`` where ``ref.column = expression over main`` for every entry of ``on``.

    ``name`` qualifies the lookup columns (``name.column``), as ``main.alias("row1")`` does for main.
    ``match`` is ``all``, ``first`` or ``unique`` (the last match); the latter two need ``order``, and
    ``tie`` names the columns that make it unique. Without keys ``ref`` is measured and becomes constants of the plan, and
    one above the bound of ``keyless_lookup`` raises.
    """
    kind = _HOW[how.lower()]
    if not on or kind == "cross":
        return keyless_lookup(main, ref, name)
    if match != "all":
        if match not in ("first", "unique") or not order:
            raise ValueError("match is all, first or unique; first and unique need an order")
        ref = recomputed(one_per_key(ref, list(on), order, match == "unique", tie), list(on))
    if kind in ("right", "full"):
        return _outer_lookup(main, ref, on, name, "inner" if kind == "right" else "left")
    return main.join(ref.alias(name), _condition(name, on), kind)


def _outer_lookup(main: DataFrame, ref: DataFrame, on: Mapping[str, Expression], name: str, kind: str) -> DataFrame:
    """Right or full outer join as inner or left join plus unmatched lookup rows.

    Adaptive execution cannot split a hot key of main in a right or full outer join; it can in these. The
    keys of main are reduced to distinct values before they are compared with the lookup.
    """
    left = main.join(ref.alias(name), _condition(name, on), kind)
    keys = main.select(*[as_column(e).alias(f"_m_{k}") for k, e in on.items()]).distinct()
    keys = recomputed(keys, keys.columns)
    match = reduce(lambda a, b: a & b, [F.col(f"{name}.{k}") == F.col(f"_m_{k}") for k in on])
    rest = ref.alias(name).join(keys, match, "left_anti")
    blanks = [F.lit(None).cast(f.dataType).alias(f.name) for f in main.schema.fields]
    return left.unionAll(rest.select(*blanks, f"{name}.*"))


# A lookup without keys must be measured to have at most so many rows and bytes.
SMALL_ROWS, SMALL_BYTES = 1_000, 1 << 20


def _constants(ref: DataFrame) -> Column:
    """All rows of a table that is measured to be small, as one constant; a larger table is an error.

    Runs a job when it is called.
    """
    size = F.octet_length(F.to_json(F.struct(*ref.columns)))
    rows, size = ref.select(size.alias("b")).limit(SMALL_ROWS + 1).agg(F.count("*"), F.sum("b")).first()
    if rows > SMALL_ROWS or (size or 0) > SMALL_BYTES:
        raise ValueError(f"a lookup without keys takes at most {SMALL_ROWS} rows and {SMALL_BYTES} bytes: give it a key")
    return ref.agg(F.collect_list(F.struct(*ref.columns)).alias("c")).scalar()


def keyless_lookup(main: DataFrame, ref: DataFrame, name: str = "lookup") -> DataFrame:
    """Every main row with every row of a lookup that is measured to be small.

    The lookup's rows are constants of each task, so main stays where it is and no join is made. Its columns come
    under their plain names. A lookup above ``SMALL_ROWS`` or ``SMALL_BYTES`` raises: such a product needs a key.
    """
    return main.select("*", F.inline(_constants(ref)))


def iterate_params(df: DataFrame, params: DataFrame, where: Expression = None, name: str = "param") -> DataFrame:
    """Run the rows of ``df`` once per parameter row, with ``param.column`` usable in ``where``.

    Parameters are bounded as the rows of a ``keyless_lookup`` are, and more of them raise; their columns follow those of ``df``.
    """
    out = df.select("*", F.explode(_constants(params)).alias(name))
    if where is not None:
        out = out.where(as_column(where, "boolean"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], f"{name}.*")


def lookup_reject(main: DataFrame, ref: DataFrame, on: Mapping[str, Expression], name: str = "lookup") -> DataFrame:
    """Main rows without any lookup match."""
    keys = recomputed(ref.select(*on).distinct(), list(on))
    return main.join(keys.alias(name), _condition(name, on), "left_anti")


def simple_join(
    main: DataFrame,
    ref: DataFrame,
    keys: Mapping[str, str],
    columns: Mapping[str, str],
    inner: bool = False,
) -> DataFrame:
    """Append chosen lookup columns to main.

    ``keys`` maps lookup column to main column, ``columns`` maps lookup column to output name.
    """
    side = ref.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_c_{c}") for c in columns]
    )
    cond = reduce(lambda a, b: a & b, [F.col(m) == F.col(f"_k_{k}") for k, m in keys.items()])
    joined = main.join(side, cond, "inner" if inner else "left")
    return joined.select(*main.columns, *[F.col(f"_c_{c}").alias(out) for c, out in columns.items()])


def _deletions(text: Column, distance: int) -> Column:
    """All texts that remain after deleting up to ``distance`` characters."""
    variants = F.array(text)
    for _ in range(distance):
        shorter = F.transform(
            variants,
            lambda s: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
                lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
            ),
        )
        variants = F.array_distinct(F.concat(variants, F.flatten(shorter)))
    return variants


# Texts of at most this many characters meet on their deletions, if these are at most so many; longer ones on parts.
_SHORT, _DELETIONS = 64, 350
# Parts that a long text is cut into, by number of edits; one more than twice the edits otherwise.
_PARTS = {1: 16, 2: 8}


def _short_size(k: int) -> int:
    """The longest text whose deletions of up to ``k`` characters are few enough to list."""
    return max(n for n in range(_SHORT + 1) if sum(comb(n, i) for i in range(k + 1)) <= _DELETIONS)


def _cuts(k: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """All ways in which at most ``k`` edits can touch ``k`` parts: (parts left out, shift of the text behind each of them)."""
    m = _PARTS.get(k, 2 * k + 1)
    steps = [d for d in product(range(-k, k + 1), repeat=k) if sum(map(abs, d)) <= k]
    return [(out, tuple(accumulate(d))) for out in combinations(range(m), k) for d in steps]


def _kept(text: Column, length: Column, cut: Column, k: int) -> Column:
    """Hash of what a text of ``length`` characters keeps without ``k`` of its parts, read in ``text``, where what follows each
    of them is shifted. ``cut``: the parts, then the shifts. NULL where the text is too short for it.
    """
    m = _PARTS.get(k, 2 * k + 1)
    bound = lambda i: F.floor(length * i / m).cast("int")
    pieces, fits = [], length > _short_size(k)
    for q in range(k + 1):
        start = F.lit(0) if q == 0 else bound(F.get(cut, F.lit(q - 1)) + 1)
        end = length if q == k else bound(F.get(cut, F.lit(q)))
        at = start + (F.lit(0) if q == 0 else F.get(cut, F.lit(k + q - 1)))
        width = F.greatest(end - start, F.lit(0))
        pieces.append(F.substr(text, F.greatest(at, F.lit(0)) + 1, width))
        fits = fits & (at >= 0) & (at + width <= F.char_length(text))
    return F.when(fits, F.xxhash64(length, F.slice(cut, 1, k) if k else F.lit(0), F.array(*pieces)))


def fuzzy_candidates(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """``_a, _b``: all pairs of distinct texts ``left._a`` and ``right._b`` within ``k`` edits, and few others.

    Short texts meet on what remains after deleting up to k characters of both. A long lookup text is cut into parts; k edits
    touch at most k of them, so a near text has all the others in order, each moved by at most k places. The lookup text is filed
    under what remains without each choice of k parts, and main texts ask for each such choice, moved in each possible way.
    Either key holds nearly all of a text, so that a beginning, an end or a part which many texts share brings none of them
    together. Rows per text depend on k only: at most 350 for short texts; 16 and 48 for long ones with one edit, 28 and 364 with two.
    """
    small = _short_size(k)
    cuts = _cuts(k)
    plain = sorted({out for out, _ in cuts})
    as_rows = lambda rows: F.expr(f"array({', '.join(f'array({str(list(r))[1:-1]})' for r in rows)})").cast("array<array<int>>")
    a_size, b_size = F.char_length("_a"), F.char_length("_b")
    filed = F.transform(as_rows([out + (0,) * k for out in plain]), lambda c: _kept(F.col("_b"), b_size, c, k))
    # The main text is longer than the lookup text by the last shift.
    moved = F.get(F.col("_cut"), F.lit(2 * k - 1)) if k else F.lit(0)
    long = right.where(b_size > small).select("_b", F.explode(F.array_distinct(filed)).alias("_v"))
    # Deletions are hashed too: a chance meeting of hashes is one more pair to compare.
    gaps = lambda name: F.transform(_deletions(F.col(name), k), lambda s: F.xxhash64(s))
    near_size = left.where(a_size + k > small)
    turned = near_size.select("_a", F.explode(as_rows([out + shifts for out, shifts in cuts])).alias("_cut"))
    asked = turned.select("_a", _kept(F.col("_a"), a_size - moved, F.col("_cut"), k).alias("_v")).where(F.col("_v").isNotNull())
    # Exploded sides are larger than their size estimates: no broadcast.
    met = asked.join(long.hint("merge"), "_v").select("_a", "_b")
    short_a = left.where(a_size <= small + k).select("_a", F.explode(gaps("_a")).alias("_v"))
    short_b = right.where(b_size <= small).select("_b", F.explode(gaps("_b")).alias("_v"))
    return met.unionAll(short_a.join(short_b.hint("merge"), "_v").select("_a", "_b")).distinct()


def fuzzy_lookup(
    main: DataFrame, ref: DataFrame, column: str, ref_column: str, max_distance: int = 1, distance: str = "distance",
    name: str = "lookup",
) -> DataFrame:
    """Main rows with every lookup row whose text is within ``max_distance`` edits, for texts of any length.

    Each distinct text is matched once, against the candidates of ``fuzzy_candidates``; rows come back by equality. NULL matches
    nothing.
    """
    k = max_distance
    left = main.select(F.col(column).alias("_a")).where(F.col("_a").isNotNull()).distinct()
    right = ref.select(F.col(ref_column).alias("_b")).where(F.col("_b").isNotNull()).distinct()
    met = fuzzy_candidates(left, right, k)
    near = met.select("_a", "_b", F.levenshtein("_a", "_b", k).alias(distance)).where(F.col(distance) >= 0)
    pairs = main.join(near, F.col(column) == F.col("_a")).drop("_a")
    return pairs.join(ref.alias(name), F.col("_b") == F.col(f"{name}.{ref_column}")).drop("_b")


def ip_number(text: Column) -> Column:
    """Dotted IPv4 address as a number; NULL when it is not one."""
    octets = F.transform(F.split(text, r"\."), lambda p: F.when(p.rlike(r"^[0-9]{1,3}\z"), p.cast("bigint")))
    number = F.aggregate(
        octets, F.lit(0).cast("bigint"), lambda total, octet: F.when(octet <= 255, total * 256 + octet)
    )
    return F.when(F.size(octets) == 4, number)


# Consecutive addresses that a range finds together, and blocks of them that a range is cut into at once.
_BLOCK, _BLOCKS = 256, 4096


def locate_ip(
    df: DataFrame, address: str, ranges: DataFrame, start: str, end: str, columns: Sequence[str]
) -> DataFrame:
    """Left lookup of a dotted address column in ``[start, end]`` number ranges; an address in several ranges has a row for each.

    Distinct addresses and the bounds of ranges are sorted together over slices. The addresses before each of its bounds
    make a range a run of positions, whose addresses it finds by blocks of positions, so that an address is one row
    however wide the ranges are, and pairs are made only where they are rows of the result. Sorts and writes when it is
    called. Ranges with a NULL bound, or that end before they start, hold nothing.
    """
    known = ranges.select(
        F.col(start).cast("bigint").alias("_first"), (F.col(end).cast("bigint") + 1).alias("_after"),
        F.struct(*columns).alias("_range"),
    ).where("_first < _after")
    known = materialize(known.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    asked = df.select(F.col(address).alias("_address")).distinct().withColumn("_value", ip_number(F.col("_address")))
    events = asked.where("_value is not null").selectExpr("_value", "1 AS _kind", "_address", "CAST(NULL AS bigint) AS _id")
    for bound in ("_first", "_after"):  # before equal addresses
        events = events.unionByName(known.selectExpr(f"{bound} AS _value", "0 AS _kind", "CAST(NULL AS string) AS _address", "_id"))
    sliced = ordered_slices(events, ["_value", "_kind"], ["_address", "_id"])
    counted = running_total(sliced, [], F.col("_kind"), "_count").select("_kind", "_address", "_id", "_count")
    counted = materialize(counted, "counted")

    runs = counted.where("_kind = 0").groupBy("_id").agg(F.min("_count").alias("_from"), F.max("_count").alias("_to"))
    runs = runs.where("_from < _to").join(known.select("_id", "_range"), "_id")
    far = f"explode(sequence(_from div {_BLOCK * _BLOCKS}, (_to - 1) div {_BLOCK * _BLOCKS})) AS _far"
    near = f"""explode(sequence(greatest(_far * {_BLOCKS}, _from div {_BLOCK}),
        least(_far * {_BLOCKS} + {_BLOCKS - 1}, (_to - 1) div {_BLOCK}))) AS _block"""
    cut = runs.selectExpr("_range", "_from", "_to", far).selectExpr("_range", "_from", "_to", near)
    cut = cut.selectExpr("_range", "_block", f"CAST(greatest(_from - _block * {_BLOCK}, 0) AS int) AS _from", f"CAST(least(_to - _block * {_BLOCK}, {_BLOCK}) AS int) AS _to")
    placed = counted.where("_kind = 1").selectExpr(f"(_count - 1) div {_BLOCK} AS _block", "struct(_count, _address) AS _item")
    blocks = placed.groupBy("_block").agg(F.sort_array(F.collect_list("_item"))["_address"].alias("_addresses"))
    found = cut.hint("merge").join(recomputed(blocks, ["_block"]), "_block")
    found = found.selectExpr("_range", "explode(slice(_addresses, _from + 1, _to - _from)) AS _address").select("_address", "_range.*")
    return df.join(found.hint("merge"), F.col(address) == F.col("_address"), "left").drop("_address")
