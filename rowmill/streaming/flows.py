"""The batch operators on unbounded flows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rowmill.operators.aggregate import Operation, aggregate_column
from rowmill.operators.scd import apply_changes, scd1, scd2
from rowmill.streaming.merged import BUCKETS, DELTAS, compact, drop_superseded, latest_version, merge_sink

__all__ = [
    "compact", "drop_superseded", "event_time", "latest_version", "merge_changes", "merge_scd1", "merge_scd2", "merge_sink", "parse_messages",
    "stream_aggregate", "stream_dedup", "stream_files", "stream_kafka", "stream_merge", "to_messages", "write_kafka", "write_stream",
]


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType | str, file_format: str = "parquet",
    max_files: int | None = None, **options,
) -> DataFrame:
    """Rows of files as they arrive below a folder or glob."""
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", **options) -> DataFrame:
    """Messages of a topic, where the Kafka package is deployed."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", starting).options(**options).load()
    )


def parse_messages(messages: DataFrame, schema: T.StructType | str, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """JSON payload to columns; a payload that does not parse gives NULLs."""
    return messages.select(*keep, F.from_json(F.col(column).cast("string"), schema).alias("_m")).select(*keep, "_m.*")


def to_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows to ``key`` and JSON ``value``, as message sinks take them."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def write_stream(
    df: DataFrame, path: str, checkpoint: str, file_format: str = "parquet", available_now: bool = False,
    every: str | None = None, **options,
) -> StreamingQuery:
    """Append a stream to files. The checkpoint makes restarts continue exactly once."""
    writer = df.writeStream.format(file_format).outputMode("append").option("checkpointLocation", checkpoint).options(**options)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start(path)


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, **options) -> StreamingQuery:
    """Send ``key``/``value`` rows to a topic, where the Kafka package is deployed."""
    return (
        df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint).options(**options).start()
    )


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a time with a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First arrival of each key; keys are forgotten ``delay`` after their time, which bounds the state."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_aggregate(
    df: DataFrame, ts: str, size: str, operations: Sequence[Operation], keys: Sequence[str] = (), slide: str | None = None,
    delay: str = "0 seconds",
) -> DataFrame:
    """Tumbling or sliding windows over event time with ``window_start`` and ``window_end``.

    Works on batch flows too. A stream emits a window once the watermark has passed its end.
    """
    frame = F.window(ts, size, slide) if slide else F.window(ts, size)
    columns = [aggregate_column(c, f).alias(o) for c, f, o in operations]
    out = event_time(df, ts).withWatermark(ts, delay).groupBy(frame.alias("_w"), *keys).agg(*columns)
    names = [o for _, _, o in operations]
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *names)


def stream_merge(
    changes: DataFrame, base: DataFrame, target: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
    available_now: bool = True, keys: Sequence[str] | None = None, buckets: int = BUCKETS, deltas: int = DELTAS,
) -> StreamingQuery:
    """Merge a stream of changes into a table; read it with ``latest_version``, also after a restart.

    The checkpoint numbers the batches, so its folder names the writer; a stream that starts anew needs a new folder.
    """
    sink = merge_sink(target, merge, base, keys, buckets, deltas, writer=checkpoint.rstrip("/"))
    writer = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merge_changes(keys: Sequence[str], sequence: Sequence[str], change: str = "change"):
    """Merge function for change rows."""
    return lambda table, batch: apply_changes(table, batch, keys, sequence, change)


def merge_scd1(keys: Sequence[str], tracked: Sequence[str]):
    return lambda table, batch: scd1(table, batch, keys, tracked)


def merge_scd2(keys: Sequence[str], tracked: Sequence[str], as_of, **names):
    return lambda table, batch: scd2(table, batch, keys, tracked, as_of, **names)
