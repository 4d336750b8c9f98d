"""File sinks. Every task writes its own files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# What stands for a backslash and for line ends in text, so that each record is one line.
LINE_CODES = (("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r"))


def one_line(df: DataFrame) -> DataFrame:
    """Text columns with line ends and backslashes written as codes."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    coded = {c: reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), LINE_CODES, F.col(f"`{c}`")) for c in text}
    return df.withColumns(coded) if coded else df


def write_delimited(
    df: DataFrame, path: str, sep: str = ",", header: bool = True, quote: str = '"', escape: str = '"',
    encoding: str = "UTF-8", mode: str = "error", compression: str | None = None, code_lines: bool = False,
) -> None:
    """Delimited text. With ``code_lines`` every record is one line, so that large files are read in parts."""
    writer = (
        (one_line(df) if code_lines else df).write.mode(mode).option("sep", sep).option("header", header).option("quote", quote).option("escape", escape)
        .option("encoding", encoding)
    )
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "rows", mode: str = "error") -> None:
    """XML rows; structs and arrays become nested elements."""
    df.write.mode(mode).format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error", rebalance: bool = True
) -> None:
    """Parquet. With partition columns the rows are first gathered by them, so that a value gets few
    files; adaptive execution splits a value that holds a large share of the rows over many tasks."""
    if not partition_by:
        df.write.mode(mode).parquet(path)
        return
    gathered = df.hint("rebalance", *[F.col(c) for c in partition_by]) if rebalance else df
    gathered.write.mode(mode).partitionBy(*partition_by).parquet(path)


def positional_line(fields: Sequence[tuple[str, int]], right: Sequence[str] = (), pad: Mapping[str, str] | None = None):
    """One fixed-width text of ``(column, width)``; ``right`` columns align right."""
    pad = pad or {}
    cells = []
    for name, width in fields:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        cells.append((F.lpad if name in right else F.rpad)(text, width, pad.get(name, " ")))
    return reduce(lambda a, b: F.concat(a, b), cells)


def write_positional(
    df: DataFrame, path: str, fields: Sequence[tuple[str, int]], right: Sequence[str] = (),
    pad: Mapping[str, str] | None = None, mode: str = "error",
) -> None:
    df.select(positional_line(fields, right, pad).alias("value")).write.mode(mode).text(path)


def write_full_row(df: DataFrame, path: str, column: str, mode: str = "error") -> None:
    """One text column as lines."""
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_lake_path(df: DataFrame, uri: str, file_format: str, mode: str = "error", **options) -> None:
    """Files below an object-store or data-lake address, by format."""
    df.write.mode(mode).format(file_format).options(**options).save(uri)
