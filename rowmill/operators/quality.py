"""Data checks. Every check table has the columns model, check, status, detail, category, recommendation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.operators.mapping import Expression, as_column

# Fixed values of the check rules.
AUDIT_PREFIXES = ("di_", "sor_", "dw_", "etl_", "batch_", "load_", "created_", "modified_")
KEY_AUDIT_PREFIXES = ("sor_", "di_", "dw_", "etl_", "batch_")
KEY_HINTS = ("key", "sk", "_id")
CODE_MARKERS = (
    r"context\.", r"Date\.[a-z]\w*\(", r"routines\.", r"StringHandling\.", r"Numeric\.sequence", r"\.getProperty\(", r"Integer\.parseInt",
    r"globalMap\.get",
)
DUPLICATE_WARN_PERCENT = 80
MANY_JOINS = 3


def _check(name: str, status: Column, detail: Column, category: str | Column, advice: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("check"), status.alias("status"), detail.alias("detail"),
        (category if isinstance(category, Column) else F.lit(category)).alias("category"),
        F.coalesce(F.lit("") if advice is None else advice, F.lit("")).alias("recommendation"),
    )


def _rows(summary: DataFrame, model: str, checks: Sequence[Column]) -> DataFrame:
    return summary.select(F.lit(model).alias("model"), F.inline(F.array(*checks)))


def pick_key(columns: Sequence[str], null_columns: Sequence[str] = ()) -> str:
    """The column whose uniqueness is checked: chosen by name, never an audit or NULL-by-design one."""
    blank = {c.lower() for c in null_columns}
    usable = [c for c in columns if c.lower() not in blank and not c.lower().startswith(KEY_AUDIT_PREFIXES)]
    named = [c for c in usable if any(h in c.lower() for h in KEY_HINTS)]
    return (named or usable or list(columns))[0]


def validate(
    df: DataFrame, model: str, null_columns: Sequence[str] = (), inner_joins: int = 0, joins: int = 0,
    cross_join: bool = False, markers: Sequence[str] = CODE_MARKERS,
) -> DataFrame:
    """Row count, schema, all-NULL columns, key uniqueness and code markers.

    All counts share one pass without a shuffle; a second pass reads the key column alone.

    ``markers`` are patterns of code that should not be left in data. ``null_columns`` are NULL by design. ``joins``, ``inner_joins`` and ``cross_join`` describe how
    the table was built and only steer the wording and the duplicate rule.
    """
    columns = df.columns
    if not columns:
        return df.sparkSession.createDataFrame(
            [(model, "Schema", "fail", "No columns", "infrastructure", "")],
            "model string, check string, status string, detail string, category string, recommendation string",
        )
    key = pick_key(columns, null_columns)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    marked = lambda c: F.col(c).rlike("|".join(markers))
    summary = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(marked(c)).alias(f"m{i}") for i, c in enumerate(text)],
    )
    # Distinct keys are counted apart: that needs a shuffle, and this way only the key goes through it.
    distinct_keys = df.select(key).agg(F.count_distinct(key).alias("n")).scalar()
    summary = summary.withColumn("distinct_keys", distinct_keys)
    rows = F.col("rows")

    if inner_joins > MANY_JOINS:
        empty = f"0 rows with {inner_joins} inner joins: a long join chain filters all data"
    elif inner_joins > 0:
        empty = f"0 rows with {inner_joins} inner joins: join keys do not match"
    else:
        empty = "0 rows: check the source and the filters"
    counted = F.concat(rows.cast("string"), F.lit(" rows"))
    row_check = _check(
        "Row Count",
        F.when(rows == 0, "fail").when(rows < 2, "warn").otherwise("pass"),
        F.when(rows == 0, empty).otherwise(counted),
        F.when(rows == 0, "logic").otherwise("data_quality"),
        F.when(rows == 0, "Trace the filters and joins back to the first one that drops all rows."),
    )
    schema_row = _check("Schema", F.lit("pass"), F.lit(f"{len(columns)} columns"), "data_quality")

    blank = {c.lower() for c in null_columns}
    expected = [c.lower() in blank or c.lower().startswith(AUDIT_PREFIXES) for c in columns]
    all_null = F.array_compact(F.array(*[F.when(F.col(f"n{i}") == 0, F.lit(c)) for i, c in enumerate(columns)]))
    surprise = F.array_compact(
        F.array(*[F.when((F.col(f"n{i}") == 0) & F.lit(not e), F.lit(c)) for i, (c, e) in enumerate(zip(columns, expected))])
    )
    shown = F.array_join(surprise, ", ")
    mostly = F.size(surprise) > len(columns) * 0.5
    null_row = _check(
        "NULL Analysis",
        F.when(mostly, "fail").when(F.size(surprise) > 0, "warn").otherwise("pass"),
        F.when(F.size(surprise) > 0, F.concat(F.size(surprise).cast("string"), F.lit(" unexpected all-NULL: "), shown))
        .when(F.size(all_null) > 0, F.concat(F.size(all_null).cast("string"), F.lit(" all-NULL columns, all expected")))
        .otherwise("No all-NULL columns"),
        F.when(mostly, "translation").otherwise("data_quality"),
        F.when(mostly, "Most columns are empty: check how they are mapped.").when(F.size(surprise) > 0, "Some columns are empty: check their sources."),
    )

    distinct = F.col("distinct_keys")
    share = F.concat(F.lit(f"{key}: "), distinct.cast("string"), F.lit("/"), rows.cast("string"), F.lit(" unique"))
    many = (1 - F.try_divide(distinct, rows)) * 100 > DUPLICATE_WARN_PERCENT
    repeated = (distinct != rows) & (distinct != 0) & many & F.lit(not cross_join and joins <= 1)
    key_row = _check(
        "Key Uniqueness",
        F.when(repeated, "warn").otherwise("pass"),
        F.when(distinct == 0, f"{key}: all NULL").otherwise(share),
        "data_quality",
        F.when(repeated, "Many duplicates from one source: a grouping may be missing."),
    )
    hits = F.array_compact(F.array(*[F.when(F.col(f"m{i}") > 0, F.lit(c)) for i, c in enumerate(text)] or [F.lit(None).cast("string")]))
    marker_row = _check(
        "Code Markers",
        F.when(F.size(hits) > 0, "fail").otherwise("pass"),
        F.when(F.size(hits) > 0, F.concat(F.lit("code left in: "), F.array_join(hits, ", "))).otherwise("No code left in the data"),
        "translation",
        F.when(F.size(hits) > 0, "These expressions were not translated: complete them."),
    )
    always = F.array(row_check, schema_row)
    # An empty table has nothing further to check.
    checks = F.when(rows == 0, always).otherwise(F.concat(always, F.array(null_row, key_row, marker_row)))
    return summary.select(F.lit(model).alias("model"), F.inline(checks))


def column_tests(df: DataFrame, model: str, not_null: Sequence[str] = (), unique: Sequence[str] = ()) -> DataFrame:
    """``not_null`` and ``unique`` tests; a unique column is also tested for NULLs.

    NULL counts share one pass. Uniqueness compares counts per value, combined before the shuffle.
    """
    required = list(dict.fromkeys([*not_null, *unique]))
    tests = []
    if required:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(required)])
        tests.append(_rows(nulls, model, [_failing(f"not_null {c}", F.col(f"n{i}")) for i, c in enumerate(required)]))
    for c in unique:
        repeated = df.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.count_if(F.col("count") > 1).alias("n"))
        tests.append(_rows(repeated, model, [_failing(f"unique {c}", F.col("n"))]))
    return reduce(lambda a, b: a.unionAll(b), tests)


def _failing(name: str, count: Column) -> Column:
    detail = F.concat(count.cast("string"), F.lit(" failing"))
    return _check(name, F.when(count > 0, "fail").otherwise("pass"), detail, "data_quality")


def lookup_match(main: DataFrame, model: str, lookups: Sequence[tuple[str, DataFrame, Mapping[str, Expression]]]) -> DataFrame:
    """Which lookup loses the rows: matched and unmatched main rows per lookup.

    Main keys are counted before each join, so the joins see one row per distinct key.
    """
    parts = []
    for name, ref, on in lookups:
        keys = main.groupBy(*[as_column(e).alias(f"_m{i}") for i, e in enumerate(on.values())]).agg(F.count("*").alias("_n"))
        side = ref.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(on)]).distinct().withColumn("_hit", F.lit(1))
        cond = reduce(lambda a, b: a & b, [F.col(f"_m{i}") == F.col(f"_r{i}") for i in range(len(on))])
        summary = keys.join(side, cond, "left").agg(
            F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_n"))), F.lit(0)).alias("matched"),
            F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("_n"))), F.lit(0)).alias("unmatched"),
        )
        detail = F.concat(F.col("matched").cast("string"), F.lit(" matched, "), F.col("unmatched").cast("string"), F.lit(" unmatched"))
        status = F.when(F.col("matched") == 0, "fail").when(F.col("unmatched") > 0, "warn").otherwise("pass")
        parts.append(_rows(summary, model, [_check(f"lookup {name}", status, detail, "logic")]))
    return reduce(lambda a, b: a.unionAll(b), parts)


def overall(checks: DataFrame) -> DataFrame:
    """Status and counts per model: fail before warn before pass."""
    counts = checks.groupBy("model").agg(
        *[F.count_if(F.col("status") == s).alias(f"checks_{s}") for s in ("pass", "warn", "fail")]
    )
    status = F.when(F.col("checks_fail") > 0, "fail").when(F.col("checks_warn") > 0, "warn").otherwise("pass")
    return counts.withColumn("status", status)


def summary(models: DataFrame) -> DataFrame:
    """Totals over ``overall`` rows with pass and health rate in whole percent; the rows themselves are the list by model."""
    count = lambda s: F.count_if(F.col("status") == s)
    total = F.greatest(F.col("total_models"), F.lit(1))
    out = models.agg(
        F.count("*").alias("total_models"), count("pass").alias("passed"), count("warn").alias("warned"), count("fail").alias("failed")
    )
    rate = lambda n: F.concat(F.rint(n / total * 100).cast("bigint").cast("string"), F.lit("%"))
    return out.withColumns(
        {"pass_rate": rate(F.col("passed")), "health_rate": rate(F.col("passed") + F.col("warned"))}
    )


def assert_rows(df: DataFrame, condition: Expression, message: str = "assertion failed") -> DataFrame:
    """The same rows; the job fails at the first row where the condition is not true."""
    ok = F.coalesce(as_column(condition, "boolean"), F.lit(False))
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def failing_rows(df: DataFrame, condition: Expression) -> DataFrame:
    """Rows where the condition is not true."""
    return df.where(~F.coalesce(as_column(condition, "boolean"), F.lit(False)))


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed difference: ``only_left``, ``only_right``, ``repeated`` or ``changed`` with the changed column names.

    A key with several rows on a side has no row to compare and is ``repeated``, whatever the rows hold;
    ``compare_bag`` compares those. One grouped union instead of a full join: every key is combined before the shuffle.
    """
    values = [c for c in left.columns if c not in keys]
    tag = lambda df, side: df.select(*keys, F.struct(*values).alias("_row"), F.lit(side).alias("_side"))
    both = tag(left, 1).unionAll(tag(right, 2))
    on = lambda side: F.when(F.col("_side") == side, F.col("_row"))
    sides = both.groupBy(*keys).agg(
        # Used only where a side has one row, so any of several will do.
        F.any_value(on(1), True).alias("_l"), F.any_value(on(2), True).alias("_r"),
        F.count(on(1)).alias("_nl"), F.count(on(2)).alias("_nr"),
    )
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), F.lit(c)) for c in values])
    )
    once = (F.col("_nl") <= 1) & (F.col("_nr") <= 1)
    difference = (
        F.when(~once, "repeated").when(F.col("_nr") == 0, "only_left").when(F.col("_nl") == 0, "only_right")
        .when(F.size(changed) > 0, "changed")
    )
    names = F.when(difference == "changed", F.array_join(changed, ",")).otherwise("")
    return sides.select(*keys, difference.alias("difference"), names.alias("columns")).where(F.col("difference").isNotNull())


def compare_bag(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, without keys; equal rows collapse before the shuffle."""
    both = left.withColumn("_n", F.lit(1)).unionAll(right.withColumn("_n", F.lit(-1)))
    return both.groupBy(*left.columns).agg(F.sum("_n").alias("surplus")).where(F.col("surplus") != 0)
