"""Database sources and sinks through JDBC.

One reader and one writer serve every vendor; the URL names the vendor and its driver jar has to
be on the class path. Reads split on a column so that executors read ranges in parallel.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_options(
    url: str, table: str | None = None, query: str | None = None, partition_column: str | None = None,
    lower: object = None, upper: object = None, partitions: int | None = None, fetch_size: int = 10_000,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options. A split read needs the column, both bounds and the number of ranges."""
    if (table is None) == (query is None):
        raise ValueError("give either table or query")
    options = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    split = (partition_column, lower, upper, partitions)
    if partition_column is None:
        options["dbtable" if table else "query"] = table or query
        return options
    if any(v is None for v in split):
        raise ValueError("a split read needs partition_column, lower, upper and partitions")
    # A split read takes its query as a derived table.
    options["dbtable"] = table or f"({query}) q"
    options.update(
        partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions)
    )
    return options


def read_jdbc(spark: SparkSession, url: str, **spec) -> DataFrame:
    """Rows of a table or query; filters and columns are pushed to the database."""
    return spark.read.format("jdbc").options(**read_options(url, **spec)).load()


def write_options(url: str, table: str, batch_size: int = 10_000, truncate: bool = False, partitions: int | None = None,
                  properties: Mapping[str, str] | None = None) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "batchsize": str(batch_size), "truncate": str(truncate).lower(), **(properties or {})}
    if partitions:
        options["numPartitions"] = str(partitions)
    return options


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **spec) -> None:
    """Write rows in batches from every task; ``truncate`` keeps the table definition on overwrite."""
    df.write.format("jdbc").options(**write_options(url, table, **spec)).mode(mode).save()
