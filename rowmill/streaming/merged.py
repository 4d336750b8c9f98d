"""A table that a stream merges into, merged on read.

    base-N/_bucket=B     rows of the hash bucket B of the keys, written by compaction N (0: the table before the stream)
    delta-N/rows, gone   all rows of the keys that a batch changed, and the changed keys that have no row any more
    commits/N            the manifest: which base version each bucket has and how many rows, which deltas lie on top, and
                         the last batch of every writer

A batch reads the current rows of its own keys, merges, and appends a delta; no base file is rewritten. Readers take a key's
rows from the newest delta that has the key, else from the base. Compaction folds the deltas into the buckets they touch.
Data is written before the commit that names it, and each commit holds the last batch of its writer: a repeated batch is
known and does nothing, whatever has been deleted meanwhile. A file that the manifest names and that is missing is an error.
One writer at a time; any number of readers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.session import materialize, scratch_scope

# Hash buckets of a base, unless given. A batch reads at most the buckets its keys fall into.
BUCKETS = 64
# Deltas on top of a base before a batch folds them in.
DELTAS = 16
_BUCKET, _VERSION, _GONE = "_bucket", "_version", "_gone"
_MANIFEST = "kind string, name string, number bigint, rows bigint"


@dataclass
class Manifest:
    """``buckets``: bucket to (base version, rows); ``writers``: writer to its last batch."""

    number: int = -1
    buckets: dict[int, tuple[int, int]] = field(default_factory=dict)
    deltas: list[int] = field(default_factory=list)
    writers: dict[str, int] = field(default_factory=dict)


def _folder(spark: SparkSession, path: str):
    """(file system, path object) of a folder in any store Spark can write to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    system, place = _folder(spark, path)
    return system.exists(place)


def _names(spark: SparkSession, path: str) -> list[str]:
    system, place = _folder(spark, path)
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


def _delete(spark: SparkSession, path: str) -> None:
    system, place = _folder(spark, path)
    system.delete(place, True)


def base_path(target: str, version: int) -> str:
    return f"{target.rstrip('/')}/base-{version:09d}"


def delta_path(target: str, version: int) -> str:
    return f"{target.rstrip('/')}/delta-{version:09d}"


def _commit_path(target: str, number: int) -> str:
    return f"{target.rstrip('/')}/commits/{number:09d}"


def _complete(spark: SparkSession, target: str):
    """Numbers of complete commits, the newest first, asked for one by one."""
    for name in sorted(_names(spark, f"{target.rstrip('/')}/commits"), reverse=True):
        if _exists(spark, f"{_commit_path(target, int(name))}/_SUCCESS"):
            yield int(name)


def read_manifest(spark: SparkSession, target: str, number: int | None = None) -> Manifest:
    """The newest commit, or the one of that number; number -1 when there is none.

    One row per bucket, delta and writer, so the list is short.
    """
    number = next(_complete(spark, target), -1) if number is None else number
    out = Manifest(number)
    if number < 0:
        return out
    for r in spark.read.schema(_MANIFEST).parquet(_commit_path(target, number)).collect():
        if r.kind == "bucket":
            out.buckets[int(r.name)] = (r.number, r.rows)
        elif r.kind == "delta":
            out.deltas.append(r.number)
        else:
            out.writers[r.name] = r.number
    out.deltas.sort()
    return out


def _commit(spark: SparkSession, target: str, state: Manifest) -> None:
    """Write the manifest, then remove all older ones but the one before it."""
    rows = [("bucket", str(b), v, n) for b, (v, n) in sorted(state.buckets.items())]
    rows += [("delta", "", v, None) for v in state.deltas] + [("writer", w, b, None) for w, b in sorted(state.writers.items())]
    out = spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite")
    out.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(_commit_path(target, state.number))
    for name in _names(spark, f"{target.rstrip('/')}/commits"):
        if int(name) < state.number - 1:
            _delete(spark, _commit_path(target, int(name)))


def _bucket(keys: Sequence[str] | None, count: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(count)).cast("int") if keys else F.lit(0)


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on keys, NULL equal to NULL."""
    named = right.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)])
    return left.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)]), how)


def _store_base(spark: SparkSession, target: str, rows: DataFrame, keys: Sequence[str] | None, count: int, version: int, only: Sequence[int]) -> dict[int, tuple[int, int]]:
    """Write buckets as files of a version; what the manifest says about each of them, empty ones included."""
    marked = rows.withColumn(_BUCKET, _bucket(keys, count)).hint("rebalance", F.col(_BUCKET))
    marked.sortWithinPartitions(_BUCKET, *(keys or [])).write.mode("overwrite").partitionBy(_BUCKET).parquet(base_path(target, version))
    schema = T.StructType([T.StructField(_BUCKET, T.IntegerType())])
    found = dict(spark.read.schema(schema).parquet(base_path(target, version)).groupBy(_BUCKET).count().collect())
    return {b: (version, found.get(b, 0)) for b in only}


def _read_base(spark: SparkSession, target: str, state: Manifest, schema: T.StructType, only: Sequence[int] | None = None) -> DataFrame:
    """Rows of the given buckets, of all when None."""
    wanted = {b: v for b, (v, n) in state.buckets.items() if n and (only is None or b in only)}
    paths = [f"{base_path(target, v)}/{_BUCKET}={b}" for b, v in sorted(wanted.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _read_deltas(spark: SparkSession, target: str, state: Manifest, schema: T.StructType, keys: Sequence[str]) -> DataFrame | None:
    """Rows of all deltas with their version, and a row for every key without rows."""
    if not state.deltas:
        return None
    found = []
    for v in state.deltas:
        rows = spark.read.schema(schema).parquet(f"{delta_path(target, v)}/rows")
        named = T.StructType([f for f in schema.fields if f.name in keys])
        gone = spark.read.schema(named).parquet(f"{delta_path(target, v)}/gone")
        found.append(rows.withColumns({_GONE: F.lit(False), _VERSION: F.lit(v)}).unionByName(
            gone.withColumns({_GONE: F.lit(True), _VERSION: F.lit(v)}), allowMissingColumns=True))
    return reduce(DataFrame.unionByName, found)


def _view(base: DataFrame, deltas: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Base and deltas by (key, version): the newest delta of a key has all its rows."""
    if deltas is None:
        return base
    newest = deltas.withColumn("_last", F.max(_VERSION).over(Window.partitionBy(*keys)))
    newest = newest.where((F.col(_VERSION) == F.col("_last")) & ~F.col(_GONE)).select(*base.columns)
    return _match(base, deltas.select(*keys).distinct(), keys, "left_anti").unionAll(newest)


def latest_version(spark: SparkSession, target: str, base: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The merged table as of the last commit, from any session; ``base`` before the first one.

    ``keys`` as given to the sink; they may be left out where no delta is on top of the base.
    """
    state = read_manifest(spark, target)
    if state.number < 0:
        return base
    if state.deltas and not keys:
        raise ValueError("this table has deltas: give its keys")
    whole = _read_base(spark, target, state, base.schema)
    return _view(whole, _read_deltas(spark, target, state, base.schema, keys or ()), keys or ())


def compact(spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str], buckets: int | None = None) -> int:
    """Fold all deltas into the base; returns the number of buckets written.

    Only buckets that a delta touches are written, unless ``buckets`` asks for another number of them. The deltas' files
    stay until ``drop_superseded``, so running readers go on.
    """
    state = read_manifest(spark, target)
    count = len(state.buckets)
    if state.number < 0 or not (state.deltas or (buckets and buckets != count)):
        return 0
    deltas = _read_deltas(spark, target, state, schema, keys)
    if buckets and buckets != count:
        touched, count = list(range(buckets)), buckets
        whole, kept = _read_base(spark, target, state, schema), {}
    else:
        touched = sorted(r[0] for r in deltas.select(_bucket(keys, count)).distinct().collect())  # at most one row per bucket
        whole, kept = _read_base(spark, target, state, schema, touched), state.buckets
    written = _store_base(spark, target, _view(whole, deltas, keys), keys, count, state.number + 1, touched)
    _commit(spark, target, Manifest(state.number + 1, {**kept, **written}, [], state.writers))
    return len(touched)


def merge_sink(
    target: str, merge: Callable[[DataFrame, DataFrame], DataFrame], base: DataFrame, keys: Sequence[str] | None = None,
    buckets: int = BUCKETS, deltas: int = DELTAS, writer: str = "stream",
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that merges each micro-batch into the table at ``target``.

    ``merge(current rows of the batch's keys, batch)`` gives the new rows of just these keys. A batch appends a delta;
    after ``deltas`` of them it also compacts. Without keys, for merges that look at the whole table such as new surrogate
    keys, every batch writes the table anew. ``writer`` names the source of the batch numbers: a number that this writer has
    committed is not merged again. Streams started from another checkpoint need another name. ``base`` is the table before the
    first batch and is dealt into ``buckets`` once; NULL keys are a key of their own.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = read_manifest(spark, target)
        if state.number < 0:
            count = buckets if keys else 1
            state = Manifest(0, _store_base(spark, target, base, keys, count, 0, range(count)))
            _commit(spark, target, state)
        if number <= state.writers.get(writer, -1):
            return
        version = state.number + 1
        writers = {**state.writers, writer: number}
        with scratch_scope(spark):
            changed = materialize(batch, "batch")
            if changed.isEmpty():
                return
            if not keys:
                rows = merge(_read_base(spark, target, state, base.schema), changed).select(*base.columns)
                _commit(spark, target, Manifest(version, _store_base(spark, target, rows, None, 1, version, [0]), [], writers))
                return
            touched = materialize(changed.select(*keys).distinct(), "keys")
            places = [r[0] for r in touched.select(_bucket(keys, len(state.buckets))).distinct().collect()]  # at most one row per bucket
            older = _read_deltas(spark, target, state, base.schema, keys)
            of_batch = lambda df: _match(df, touched, keys, "left_semi")
            current = _view(of_batch(_read_base(spark, target, state, base.schema, places)), None if older is None else of_batch(older), keys)
            merge(current, changed).select(*base.columns).write.mode("overwrite").parquet(f"{delta_path(target, version)}/rows")
            left = spark.read.schema(base.schema).parquet(f"{delta_path(target, version)}/rows")
            _match(touched, left, keys, "left_anti").write.mode("overwrite").parquet(f"{delta_path(target, version)}/gone")
        _commit(spark, target, Manifest(version, state.buckets, [*state.deltas, version], writers))
        if len(state.deltas) + 1 >= deltas:
            compact(spark, target, base.schema, keys)

    return run


def drop_superseded(spark: SparkSession, target: str) -> int:
    """Delete buckets and deltas that neither of the two newest commits names; returns how many folders went.

    Run it while no reader still uses an earlier version.
    """
    newest = list(_complete(spark, target))[:2]
    if not newest:
        return 0
    states = [read_manifest(spark, target, n) for n in newest]
    kept = {(f"base-{v:09d}", f"{_BUCKET}={b}") for s in states for b, (v, n) in s.buckets.items()}
    lying = {f"delta-{v:09d}" for s in states for v in s.deltas}
    root, gone = target.rstrip("/"), 0
    for name in _names(spark, root):
        kind, _, version = name.partition("-")
        if kind not in ("base", "delta") or int(version) > newest[0]:
            continue  # a later number is a batch that is being written
        if kind == "delta":
            drop = [] if name in lying else [name]
        else:
            drop = [f"{name}/{part}" for part in _names(spark, f"{root}/{name}") if part.startswith(f"{_BUCKET}=") and (name, part) not in kept]
        for part in drop:
            _delete(spark, f"{root}/{part}")
            gone += 1
    return gone
