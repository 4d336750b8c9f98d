"""Streams over the event table, run until the input is used up, then read back."""

from pyspark.sql import functions as F

from rowmill.operators import scd
from rowmill.plans.history import _FEED
from rowmill.plans.registry import query
from rowmill.session import scratch_path
from rowmill.sinks.files import write_parquet
from rowmill.streaming import flows


def _stream(t, name="events"):
    source = t.spark.read.parquet(t.path(name))
    return flows.stream_files(t.spark, f"{t.folder}/{name}*.parquet", source.schema)


def _finish(t, df):
    path = scratch_path(t.spark, "stream")
    flows.write_stream(df, path, scratch_path(t.spark, "checkpoint"), available_now=True).awaitTermination()
    return t.spark.read.schema(df.schema).parquet(path)


@query("st01_messages", "SELECT event_id, user_id, event_type, value FROM events")
def st01(t):
    path = scratch_path(t.spark, "messages")
    write_parquet(flows.to_messages(t.events.select("event_id", "user_id", "event_type", "value"), key="user_id"), path)
    messages = flows.stream_files(t.spark, path, "key string, value string")
    return _finish(t, flows.parse_messages(messages, "event_id bigint, user_id bigint, event_type string, value double"))


@query("st02_st03_files", "SELECT event_id, upper(event_type) AS kind, ts FROM events WHERE value > 50")
def st02(t):
    return _finish(t, _stream(t).where("value > 50").select("event_id", F.upper("event_type").alias("kind"), "ts"))


@query("st04_dedup", "SELECT event_id, ts::TIMESTAMP AS ts FROM events")
def st04(t):
    twice = _stream(t).select("event_id", "ts").unionAll(_stream(t).select("event_id", "ts"))
    return _finish(t, flows.stream_dedup(twice, ["event_id"], "ts", "40 days"))


_WINDOWS = """SELECT CAST(w AS TIMESTAMP) AS window_start, CAST(w + INTERVAL {size} AS TIMESTAMP) AS window_end, event_type, count(event_id) AS n, max(value) AS top
   FROM (SELECT *, unnest(generate_series(time_bucket(INTERVAL {slide}, ts, TIMESTAMP '1970-01-01') - INTERVAL {size} + INTERVAL {slide},
     time_bucket(INTERVAL {slide}, ts, TIMESTAMP '1970-01-01'), INTERVAL {slide})) AS w FROM events) WHERE w + INTERVAL {size} <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL {delay}
   GROUP BY w, event_type"""


@query("st05_tumbling", _WINDOWS.format(size="1 DAY", slide="1 DAY", delay="1 HOUR"))
def st05(t):
    ops = [("event_id", "count", "n"), ("value", "max", "top")]
    return _finish(t, flows.stream_aggregate(_stream(t), "ts", "1 day", ops, ["event_type"], delay="1 hour"))


@query("st05_sliding", _WINDOWS.format(size="6 HOUR", slide="2 HOUR", delay="30 MINUTE"))
def st05_sliding(t):
    ops = [("event_id", "count", "n"), ("value", "max", "top")]
    return _finish(t, flows.stream_aggregate(_stream(t), "ts", "6 hours", ops, ["event_type"], slide="2 hours", delay="30 minutes"))


_MERGED = """SELECT coalesce(c.c_custkey, l.c_custkey) AS c_custkey, c.c_name AS c_name, coalesce(l.c_mktsegment, c.c_mktsegment) AS c_mktsegment
        FROM {0} c FULL JOIN (SELECT * FROM ({1}) WHERE event_id % 2 = {2} QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY ts DESC, event_id DESC) = 1) l
        ON l.c_custkey = c.c_custkey WHERE coalesce(l.op, '') <> 'D'"""


@query("st06_merge_changes", f"WITH first AS ({_MERGED.format('customer', _FEED, 0)}) {_MERGED.format('first', _FEED, 1)}")
def st06(t):
    """Two starts over halves of the input, and a third one that finds nothing new."""
    from rowmill.plans.history import _feed

    target, checkpoint, inbox = (scratch_path(t.spark, n) for n in ("dimension", "checkpoint", "inbox"))
    base = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    merge = flows.merge_changes(["c_custkey"], ["ts", "event_id"])
    for part in ("event_id % 2 = 0", "event_id % 2 = 1", "false"):
        t.events.where(part).write.mode("append").parquet(inbox)

        class Streamed:
            events = flows.stream_files(t.spark, inbox, t.events.schema)

        changes = scd.read_change_feed(_feed(Streamed), "op")
        flows.stream_merge(changes, base, target, checkpoint, merge, keys=["c_custkey"], buckets=8).awaitTermination()
    return flows.latest_version(t.spark, target, base, ["c_custkey"])


@query("st06_merge_compacted", f"WITH first AS ({_MERGED.format('customer', _FEED, 0)}) {_MERGED.format('first', _FEED, 1)}")
def st06_compacted(t):
    """The same halves as batches of one sink, each sent twice as after a crash, with a compaction after every delta."""
    from rowmill.plans.history import _feed

    target = scratch_path(t.spark, "dimension")
    base = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    sink = flows.merge_sink(target, flows.merge_changes(["c_custkey"], ["ts", "event_id"]), base, ["c_custkey"], buckets=8, deltas=1)
    for number in (0, 0, 1, 1):

        class Half:
            events = t.events.where(F.col("event_id") % 2 == number)

        sink(scd.read_change_feed(_feed(Half), "op"), number)
        flows.drop_superseded(t.spark, target)
    return flows.latest_version(t.spark, target, base)
