"""Compare a registered query with its SQL, row by row."""

import datetime
import math
import os
from collections import Counter

import duckdb

from rowmill.plans.registry import TABLES

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
    "binary": "BLOB",
}


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(spark, con, folder, fn, sql):
    """Problems found, empty when both sides agree."""
    df = fn(spark, folder)
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return [f"columns {names} != {sorted(rel.columns)}"]
    problems = []
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for name, kind in df.dtypes:
        want = KINDS.get(kind, kind.upper())
        if theirs[name] != want:
            problems.append(f"type of {name}: {kind} != {theirs[name]}")
    mine = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    order = [rel.columns.index(n) for n in names]
    other = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if mine != other:
        left, right = list((mine - other).items())[:3], list((other - mine).items())[:3]
        problems.append(f"rows {sum(mine.values())} vs {sum(other.values())}\n  columns {names}\n  only spark {left}\n  only sql   {right}")
    return problems
