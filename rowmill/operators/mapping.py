"""Column mapping: output expressions, variables, filters, several outputs, parameters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.session import scratch_path

Expression = Column | str | None


def as_column(expression: Expression, kind: str | T.DataType = "string") -> Column:
    """A Column, an SQL expression, or a typed NULL for a blank expression."""
    if isinstance(expression, Column):
        return expression
    if expression is None or not expression.strip():
        return F.lit(None).cast(kind)
    return F.expr(expression)


def _variable_levels(variables: Mapping[str, Expression]) -> list[list[str]]:
    """Variables that can be computed side by side, level by level.

    A variable comes after those it uses, and not before an earlier one that still uses the former value of its name.
    What a ready Column uses, or an expression over ``Var`` as a whole, is not known: it comes after all earlier variables
    and before all later ones.
    """
    uses: dict[str, set[str] | None] = {}
    level: dict[str, int] = {}
    for name, expression in variables.items():
        text = "" if expression is None else expression
        fields = [] if isinstance(text, Column) else re.findall(r"\bVar\b`?(?:\s*\.\s*`?(\w+))?", text, re.IGNORECASE)
        own = None if isinstance(text, Column) or "" in fields else {x.lower() for x in fields}
        after = [level[e] + 1 for e, used in uses.items() if own is None or used is None or e.lower() in own]
        beside = [level[e] for e, used in uses.items() if used is not None and name.lower() in used]
        level[name] = max([0, *after, *beside])
        uses[name] = own
    return [[n for n in variables if level[n] == i] for i in range(max(level.values(), default=-1) + 1)]


def with_variables(df: DataFrame, variables: Mapping[str, Expression]) -> DataFrame:
    """Add a struct ``Var`` with the variables; a later one may use an earlier one as ``Var.x``.

    Variables that do not use each other are computed in one projection.
    """
    for names in _variable_levels(variables):
        values = {n: as_column(variables[n]) for n in names}
        if "Var" in df.columns:
            df = df.withColumn("Var", reduce(lambda var, n: var.withField(n, values[n]), names, F.col("Var")))
        else:
            df = df.withColumn("Var", F.struct(*[v.alias(n) for n, v in values.items()]))
    return df


def with_context(df: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Make parameters usable as ``context.name`` in any expression over ``df``.

    The values are literals (or scalar subqueries, see ``load_context``), so they fold into filters and reach the scan.
    """
    values = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in params.items()]
    return df.withColumn("context", F.struct(*values)) if values else df


def load_context(rows: DataFrame, names: Sequence[str], name: str = "key", value: str = "value") -> dict[str, Column]:
    """Named parameters from ``(key, value)`` rows of a file or table, for ``with_context``.

    Each is a scalar subquery over the rows of its key, so nothing is collected and tables of any size will do. A key
    without a row gives NULL, one with several rows its largest value.
    """
    return {n: rows.where(F.col(name) == n).agg(F.max(value).alias(n)).scalar() for n in names}


def _expressions(columns: Mapping[str, Expression | tuple[Expression, str]]) -> list[Column]:
    out = []
    for name, spec in columns.items():
        expression, kind = spec if isinstance(spec, tuple) else (spec, None)
        column = as_column(expression, kind or "string")
        out.append((column.cast(kind) if kind else column).alias(name))
    return out


def map_columns(
    df: DataFrame,
    columns: Mapping[str, Expression | tuple[Expression, str]],
    variables: Mapping[str, Expression] | None = None,
    where: Expression = None,
) -> DataFrame:
    """Ordered output columns from expressions, after an optional row filter.

    A blank expression gives a NULL column; ``(expression, type)`` casts. An unknown column
    fails when the plan is analysed and never turns into NULL.
    """
    if variables:
        df = with_variables(df, variables)
    if where is not None:
        df = df.where(as_column(where, "boolean"))
    return df.select(*_expressions(columns))


def tag_outputs(df: DataFrame, outputs: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """The rows of several outputs in one pass: ``output``, the name, and ``row``, a struct with one struct per output.

    A row is there once for each output it belongs to; in ``row`` only that output's struct is set. ``outputs`` as for
    ``map_outputs``. Expressions of an output are evaluated for its own rows only. Rows of no output are left out, an
    empty table gives no rows.
    """
    if not outputs:
        raise ValueError("give at least one output")
    # A filter may use its output's variables, so each test is made beside them and the variables are dropped again.
    marked = df.withColumn("_var", F.col("Var")) if "Var" in df.columns else df
    plain = marked.columns
    restore = lambda rows: rows.withColumn("Var", F.col("_var")) if "_var" in plain else rows.drop("Var")
    tests = {}
    for i, (name, spec) in enumerate(outputs.items()):
        if spec.get("reject"):
            continue
        if spec.get("where") is None:
            tests[name] = F.lit(True)
            continue
        test = F.coalesce(as_column(spec["where"], "boolean"), F.lit(False))
        variables = spec.get("variables")
        marked = (with_variables(marked, variables) if variables else marked).withColumn(f"_in{i}", test)
        marked = restore(marked) if variables else marked
        tests[name] = F.col(f"_in{i}")
    accepted = F.lit(False)
    for test in tests.values():
        accepted = accepted | test
    tags = [F.when(tests.get(name, ~accepted), F.lit(name)) for name in outputs]
    marked = marked.withColumn("_output", F.explode(F.array_compact(F.array(*tags))))
    rows = []
    for i, (name, spec) in enumerate(outputs.items()):
        own = F.col("_output") == name
        variables = {k: F.when(own, as_column(v)) for k, v in (spec.get("variables") or {}).items()}
        fields = F.when(own, F.struct(*_expressions(spec["columns"])))
        marked = (with_variables(marked, variables) if variables else marked).withColumn(f"_row{i}", fields)
        marked = restore(marked) if variables else marked
        rows.append(F.col(f"_row{i}").alias(name))
    return marked.select(F.col("_output").alias("output"), F.struct(*rows).alias("row"))


def map_outputs(
    df: DataFrame, outputs: Mapping[str, Mapping[str, Any]], one_pass: bool = True
) -> dict[str, DataFrame]:
    """Several outputs over one input.

    An output has ``columns`` and optionally ``where``, ``variables`` and ``reject=True``. A reject
    output gets the rows no filtered output accepted; NULL filters count as not accepted.

    The input is read once, when this is called: its rows are written to the shared folder in one folder per output, and
    each output reads its own. ``one_pass=False`` plans each output over the input by itself, which reads the input
    once per output but writes nothing: for outputs of a few rows or columns straight from a file, whose filters reach
    the scan. Beside a reject output, filters then cannot use variables. The rows are the same.
    """
    if one_pass and len(outputs) > 1:
        path = scratch_path(df.sparkSession, "outputs")
        tagged = tag_outputs(df, outputs)
        tagged.write.partitionBy("output").parquet(path)
        staged = df.sparkSession.read.schema(tagged.schema).parquet(path)
        return {n: staged.where(F.col("output") == n).select(F.col("row")[n].alias("r")).select("r.*") for n in outputs}
    filters = [spec.get("where") for spec in outputs.values() if not spec.get("reject")]
    accepted = F.lit(any(f is None for f in filters))
    for where in filters:
        if where is not None:
            accepted = accepted | F.coalesce(as_column(where, "boolean"), F.lit(False))
    return {
        name: map_columns(
            df, spec["columns"], spec.get("variables"), ~accepted if spec.get("reject") else spec.get("where")
        )
        for name, spec in outputs.items()
    }


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep and order columns."""
    return df.select(*columns)


def replace_rows(df: DataFrame, condition: Expression, assignments: Mapping[str, Expression]) -> DataFrame:
    """Give new values to columns of the rows that meet the condition."""
    hit = F.coalesce(as_column(condition, "boolean"), F.lit(False))
    fields = {f.name: f.dataType for f in df.schema.fields}
    new = {
        name: F.when(hit, as_column(expression).cast(fields[name])).otherwise(F.col(name))
        for name, expression in assignments.items()
    }
    return df.withColumns(new)


def count_loop(df: DataFrame, count: Column | int | str, name: str = "iteration") -> DataFrame:
    """Repeat each row ``count`` times with the loop number 1..count; 0 or less gives no row."""
    n = F.lit(count) if isinstance(count, int) else F.col(count) if isinstance(count, str) else count
    n = n.cast("bigint")
    # An outer sequence of blocks keeps every generated array at 10,000 entries or fewer.
    block = 10_000
    blocks = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block).cast("bigint")))
    out = df.withColumn("_n", n).withColumn("_block", F.explode(blocks))
    first = F.col("_block") * block + 1
    out = out.withColumn(name, F.explode(F.sequence(first, F.least(F.col("_n"), first + block - 1))))
    return out.drop("_n", "_block")
