"""Table sinks and table definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def materialize_as(
    df: DataFrame, name: str, as_: str = "view", mode: str = "overwrite", partition_by: Sequence[str] = (),
    bucket_by: tuple[int, str] | None = None, path: str | None = None,
) -> DataFrame:
    """Publish a result as a view (nothing is computed) or as a stored table, and return it.

    Bucketing a table on its join key lets later joins on that key skip the shuffle.
    """
    spark = df.sparkSession
    if as_ == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if as_ != "table":
        raise ValueError("as_ is view or table")
    writer = df.write.mode(mode)
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], bucket_by[1]).sortBy(bucket_by[1])
    writer.saveAsTable(name)
    return spark.table(name)


def elt_output(df: DataFrame, table: str, overwrite: bool = False) -> None:
    """Insert a result into an existing table, columns matched by name."""
    target = df.sparkSession.table(table)
    df.select(*target.columns).write.insertInto(table, overwrite=overwrite)


def create_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None, if_not_exists: bool = True) -> None:
    exists = "IF NOT EXISTS " if if_not_exists else ""
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields
    )
    location = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE {exists}{name} ({columns}) USING parquet{location}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def truncate_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")
