"""Tables, queries, inline and generated rows, shared flows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from rowmill.operators.mapping import Expression, as_column


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalogue table or view, with the declared columns only when they are given."""
    df = spark.table(name)
    return df.select(*columns) if columns else df


def read_query(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """Rows of an SQL text with ``:name`` parameters and ``{name}`` DataFrames."""
    return spark.sql(sql, args=dict(params or {}), **tables)


def run_sql(spark: SparkSession, statement: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """Run one statement."""
    return spark.sql(statement, args=dict(params)) if params else spark.sql(statement)


def fixed_rows(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: T.StructType | str) -> DataFrame:
    """Inline rows."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def generate_rows(spark: SparkSession, n: int, columns: Mapping[str, Expression], partitions: int | None = None) -> DataFrame:
    """``n`` rows; expressions may use ``id`` from 0."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.select(*[as_column(e).alias(c) for c, e in columns.items()])


_BLOCK = 10_000


def generate_rows_per(df: DataFrame, count: str, columns: Mapping[str, Expression]) -> DataFrame:
    """For each row as many copies as its column ``count`` says (none for NULL or below 1), with further columns.

    Expressions may use ``id`` from 0 and the row's own columns. Large counts are made block by block, so that
    no array grows with them.
    """
    last = F.col(count).cast("bigint") - 1
    blocks = df.where(F.col(count) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / _BLOCK))))
    first = F.col("_block") * _BLOCK
    ids = F.explode(F.sequence(first, F.least(last, first + (_BLOCK - 1))))
    rows = blocks.withColumn("id", ids).drop("_block")
    return rows.select("*", *[as_column(e).alias(c) for c, e in columns.items()]).drop("id")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Keep a flow for later jobs of this session under a name; spills to disk."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.createOrReplaceTempView(name)
    return kept


def staged(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def list_sources(spark: SparkSession, database: str | None = None) -> DataFrame:
    """``(name, database, kind, columns)`` of every table and view in the catalogue."""
    rows = []
    for t in spark.catalog.listTables(database):
        columns = spark.table(t.name if t.isTemporary else f"{t.namespace[0]}.{t.name}" if t.namespace else t.name).columns
        rows.append((t.name, t.namespace[0] if t.namespace else "", t.tableType, len(columns)))
    return spark.createDataFrame(rows, "name string, database string, kind string, columns int")


def list_columns(spark: SparkSession, name: str) -> DataFrame:
    """``(column, type, nullable, ordinal)`` of a table or view."""
    fields = spark.table(name).schema.fields
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "`column` string, type string, nullable boolean, ordinal int")


def unescape_columns(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """Rename ``_word`` to ``word`` for reserved words that were escaped on the way in."""
    reserved = {w.lower() for w in words}
    taken = set(df.columns)
    names = {
        c: c[1:] for c in df.columns if c.startswith("_") and c[1:].lower() in reserved and c[1:] not in taken
    }
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
