"""Casts, replacements, schema and pattern checks, masking."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.operators import Split


def convert_types(df: DataFrame, types: Mapping[str, str | T.DataType]) -> Split:
    """Cast columns; rows with a value that does not convert go to the reject flow unchanged."""
    failed = reduce(
        lambda a, b: a | b,
        [F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() for c, t in types.items()],
    )
    ok = df.where(~failed).withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
    return Split(ok, df.where(failed))


@dataclass(frozen=True)
class Replacement:
    """One search/replace rule for a column."""

    column: str
    search: str
    replace: str
    whole_word: bool = False
    ignore_case: bool = False
    regex: bool = False


def _quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def replace_values(df: DataFrame, rules: Sequence[Replacement]) -> DataFrame:
    """Apply the rules in order."""
    for rule in rules:
        column = F.col(rule.column)
        if not (rule.whole_word or rule.ignore_case or rule.regex):
            new = F.replace(column, F.lit(rule.search), F.lit(rule.replace))
        else:
            pattern = rule.search if rule.regex else _quote(rule.search)
            if rule.whole_word:
                pattern = rf"\b(?:{pattern})\b"
            if rule.ignore_case:
                pattern = f"(?i){pattern}"
            new = F.regexp_replace(column, pattern, rule.replace if rule.regex else re.sub(r"([\\$])", r"\\\1", rule.replace))
        df = df.withColumn(rule.column, new)
    return df


# Bits of errorCode in rejected rows.
BAD_TYPE, IS_NULL, TOO_LONG = 1, 2, 4


def schema_check(df: DataFrame, schema: T.StructType) -> Split:
    """Check types, nullability and text length (field metadata ``length``) in one pass.

    Good rows come back with the schema's types. Rejected rows keep their values and get
    ``errorCode`` (a sum of bits) and ``errorMessage``.
    """
    rules: list[tuple[Column, int, str]] = []
    for field in schema.fields:
        column = F.col(field.name)
        if df.schema[field.name].dataType != field.dataType:
            bad = column.isNotNull() & column.try_cast(field.dataType).isNull()
            rules.append((bad, BAD_TYPE, f"{field.name}: not {field.dataType.simpleString()}"))
        if not field.nullable:
            rules.append((column.isNull(), IS_NULL, f"{field.name}: is null"))
        if field.metadata.get("length"):
            long = F.coalesce(F.length(column.cast("string")) > field.metadata["length"], F.lit(False))
            rules.append((long, TOO_LONG, f"{field.name}: longer than {field.metadata['length']}"))
    code = F.lit(0)
    for bit in (BAD_TYPE, IS_NULL, TOO_LONG):
        tests = [t for t, b, _ in rules if b == bit]
        if tests:
            code = code + F.when(reduce(lambda a, b: a | b, tests), bit).otherwise(0)
    message = F.concat_ws("; ", *[F.when(test, F.lit(text)) for test, _, text in rules])
    checked = df.withColumns({"errorCode": code, "errorMessage": message})
    ok = checked.where(F.col("errorCode") == 0).drop("errorCode", "errorMessage")
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    return Split(ok.withColumns(typed), checked.where(F.col("errorCode") != 0))


def pattern_check(df: DataFrame, column: str, pattern: str) -> Split:
    """Rows whose whole value matches the pattern, and the rest (NULL included)."""
    match = F.coalesce(F.col(column).rlike(rf"^(?:{pattern})\z"), F.lit(False))
    return Split(df.where(match), df.where(~match))


def mask_value(column: Column, method: str) -> Column:
    """``hash``, ``mask`` (letters and digits to X, x, n), ``digits``, ``keep_last4``, ``initial`` or ``null``."""
    if method == "hash":
        return F.sha2(column.cast("string"), 256)
    if method == "mask":
        return F.mask(column)
    if method == "digits":
        return F.regexp_replace(column, "[0-9]", "#")
    if method == "keep_last4":
        hidden = F.repeat(F.lit("*"), F.greatest(F.length(column) - 4, F.lit(0)))
        return F.concat(hidden, F.right(column, F.lit(4)))
    if method == "initial":
        return F.concat(F.left(column, F.lit(1)), F.lit("***"))
    if method == "null":
        return F.lit(None).cast("string")
    raise ValueError(f"unknown mask {method!r}")


def mask(df: DataFrame, methods: Mapping[str, str]) -> DataFrame:
    """Mask columns."""
    return df.withColumns({c: mask_value(F.col(c), m) for c, m in methods.items()})
