"""Queries of the text operators, each next to its SQL where SQL can express it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowmill.plans.registry import Tables
from rowmill.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Session defaults, and this package on the path of the Python workers, which run its functions."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="rowmill-"), "rowmill.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join("rowmill", os.path.relpath(path, package)))
        context.addPyFile(archive)
    return configure(spark)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(prepare(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
