"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators are written for. Everything here is a runtime SQL setting, so a
# cluster session that already sets its own values keeps working.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one extra shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "rowmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Give an existing session the defaults above where its launch configuration sets none."""
    launched = spark.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if not launched.contains(key) and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A temporary folder is used only on a local master where nothing is configured.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    configured = configured or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="rowmill-"))
    return context.getCheckpointDir().rstrip("/")


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str = "data") -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/rowmill-{label}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what was written to the shared folder inside, at the end.

    Results read their copies when an action runs, so store or collect them before the scope ends.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not made]
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Survives executor loss, cuts the lineage, and keeps column pruning for the readers.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Parts that the rows of one key are dealt into in a table stored by a key that has more rows than HOT_KEY somewhere.
SALTS, HOT_KEY = 8, 250_000
# Rows of a bucket on average, at most: a large table has more buckets than there are shuffle partitions.
BUCKET_ROWS = 500_000
SALT = "_salt"


class StoredBy:
    """Tables stored in buckets of (key, salt), so that small sides are joined to them again and again without an exchange
    of the stored rows, and the rows of a hot key lie in several buckets. Use it as a context: the table names go at its
    end, the files stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, hot: int | None = None):
        self.spark, self.names, self.salts = spark, [], {}
        self.hot = HOT_KEY if hot is None else hot
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> StoredBy:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def write(self, df: DataFrame, key: str, label: str) -> StoredTable:
        """``df`` without rows of a NULL key, stored by ``key``. Counts the rows per key first."""
        known = df.where(F.col(key).isNotNull())
        most, rows = known.groupBy(key).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
        salts = SALTS if most > self.hot else 1
        rest = [F.col(c) for c in df.columns if c != key]
        salted = known.withColumn(SALT, F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
        return StoredTable(self.append(salted, f"rowmill_{label}_{uuid.uuid4().hex}", [key, SALT], max(self.buckets, ceil(rows / BUCKET_ROWS))), key, salts)

    def append(self, df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
        """Add rows to a table in buckets of ``keys``, as many as shuffle partitions if not given, which is made if it is new."""
        buckets = buckets or self.buckets
        writer = df.repartition(buckets, *keys).write.mode("append").bucketBy(buckets, *keys).sortBy(*keys)
        if name not in self.names:
            self.names.append(name)
            writer = writer.option("path", scratch_path(self.spark, name))
        writer.saveAsTable(name)
        return self.spark.table(name)


@dataclass
class StoredTable:
    """A table of ``StoredBy.write``."""

    table: DataFrame
    key: str
    salts: int

    def matched(self, small: DataFrame) -> DataFrame:
        """``small`` joined with all rows of its keys; it is repeated once per salt, the stored side stays where it is.

        ``small`` has distinct keys and is hashed bucket by bucket, so that the stored rows are not sorted again each time.
        """
        every = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        return every.hint("shuffle_hash").join(self.table, [self.key, SALT]).drop(SALT)
