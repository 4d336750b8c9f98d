"""Fields out of text, JSON and XML columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.operators.reshape import explode_rows


def extract_regex(df: DataFrame, column: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """Capture groups to columns; NULL where the pattern does not match."""
    source = F.col(column)
    groups = {n: F.when(source.rlike(pattern), F.regexp_extract(source, pattern, i + 1)) for i, n in enumerate(names)}
    return df.withColumns(groups)


def extract_delimited(df: DataFrame, column: str, separator: str, names: Sequence[str]) -> DataFrame:
    """Parts of a delimited text to columns; NULL where there are fewer parts."""
    parts = F.split(F.col(column), r"\Q" + separator + r"\E")
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def extract_positional(
    df: DataFrame, column: str, fields: Sequence[tuple[str, int, int]], trim: bool = True
) -> DataFrame:
    """Fixed-width parts ``(name, start, length)``, start counted from 0."""
    out = {}
    for name, start, length in fields:
        part = F.substring(F.col(column), start + 1, length)
        out[name] = F.trim(part) if trim else part
    return df.withColumns(out)


def extract_json(
    df: DataFrame, column: str, paths: Mapping[str, str], loop: str | None = None
) -> DataFrame:
    """JSON values by path. With ``loop`` (path of an array) one row per element, paths relative to it."""
    source = F.col(column)
    if loop:
        items = F.from_json(F.get_json_object(source, loop), T.ArrayType(T.StringType()))
        df = explode_rows(df, items, "_item")
        source = F.col("_item")
    out = df.withColumns({n: F.get_json_object(source, p) for n, p in paths.items()})
    return out.drop("_item")


def extract_xml(df: DataFrame, column: str, paths: Mapping[str, str]) -> DataFrame:
    """XML values by XPath; NULL where the node is missing."""
    out = {
        n: F.when(F.xpath_boolean(F.col(column), F.lit(p)), F.xpath_string(F.col(column), F.lit(p)))
        for n, p in paths.items()
    }
    return df.withColumns(out)


def map_xml(df: DataFrame, column: str, schema: T.StructType | str, loop: str | None = None) -> DataFrame:
    """Parse an XML document column; one row per element of the ``loop`` field, its fields as columns."""
    parsed = df.withColumn("_doc", F.from_xml(F.col(column), schema if isinstance(schema, str) else schema.simpleString()))
    rest = [c for c in df.columns if c != column]
    if loop is None:
        return parsed.select(*rest, "_doc.*")
    return parsed.select(*rest, F.explode_outer(F.col(f"_doc.{loop}")).alias("_node")).select(*rest, "_node.*")


def build_xml(df: DataFrame, columns: Sequence[str], name: str = "document", row_tag: str = "ROW") -> DataFrame:
    """Rows back to an XML document column."""
    document = F.to_xml(F.struct(*columns), {"rowTag": row_tag})
    return df.withColumn(name, document).drop(*[c for c in columns if c != name])
