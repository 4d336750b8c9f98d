"""Streams over several files, against the batch result."""

import glob
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowmill import scratch_path
from rowmill.operators import scd
from rowmill.streaming import flows, merged


@pytest.fixture(scope="module")
def days(spark, sf):
    """Events as one file per ten days, written in time order."""
    path = scratch_path(spark, "days")
    events = spark.read.parquet(f"{sf}/events.parquet")
    for low, high in ((1, 10), (11, 20), (21, 31)):
        events.where(F.dayofmonth("ts").between(low, high)).coalesce(1).write.mode("append").parquet(path)
    return path, events


def run(spark, df):
    path = scratch_path(spark, "out")
    query = flows.write_stream(df, path, scratch_path(spark, "ckpt"), available_now=True)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path), query


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_files_in_three_batches(spark, days):
    path, events = days
    stream = flows.stream_files(spark, path, events.schema, max_files=1)
    got, query = run(spark, stream.select("event_id", "value"))
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
    assert rows_of(got) == rows_of(events.select("event_id", "value"))


def test_restart_continues(spark, days):
    path, events = days
    stream = flows.stream_files(spark, path, events.schema).select("event_id")
    target, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    for _ in range(2):
        flows.write_stream(stream, target, checkpoint, available_now=True).awaitTermination()
    assert spark.read.parquet(target).count() == events.count()


def test_windows_over_batches_match_batch_windows(spark, days):
    path, events = days
    ops = [("event_id", "count", "n"), ("value", "max", "top")]
    stream = flows.stream_files(spark, path, events.schema, max_files=1)
    got, _ = run(spark, flows.stream_aggregate(stream, "ts", "1 day", ops, ["event_type"], delay="1 hour"))
    whole = flows.stream_aggregate(events, "ts", "1 day", ops, ["event_type"])
    last = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    closed = whole.where(F.col("window_end") <= F.lit(last) - F.expr("INTERVAL 1 HOUR"))
    assert rows_of(got) == rows_of(closed) and got.count() > 0


def test_dedup_across_batches(spark, days):
    path, events = days
    stream = flows.stream_files(spark, path, events.schema, max_files=1).select("event_id", "ts")
    again = flows.stream_files(spark, path, events.schema, max_files=2).select("event_id", "ts")
    got, _ = run(spark, flows.stream_dedup(stream.unionAll(again), ["event_id"], "ts", "60 days"))
    assert rows_of(got.select("event_id")) == rows_of(events.select("event_id"))


def test_messages_that_do_not_parse_give_nulls(spark):
    path = scratch_path(spark, "messages")
    spark.createDataFrame([('{"a": 1}',), ("nonsense",)], "value string").write.parquet(path)
    stream = flows.parse_messages(flows.stream_files(spark, path, "value string"), "a int", keep=["value"])
    got, _ = run(spark, stream)
    assert rows_of(got) == Counter([('{"a": 1}', 1), ("nonsense", None)])


def test_merge_in_batches_equals_one_merge(spark, days, sf):
    path, events = days
    base = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("state"))

    def feed(df):
        op = F.when(F.col("event_type") == "error", "D").otherwise("U")
        return scd.read_change_feed(df.select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("state"), "ts", "event_id", op.alias("op")), "op")

    changes = feed(flows.stream_files(spark, path, events.schema, max_files=1))
    once = scd.apply_changes(base, feed(events), ["c_custkey"], ["ts", "event_id"])
    for keys in (None, ["c_custkey"]):
        target = scratch_path(spark, "dim")
        merge = flows.merge_changes(["c_custkey"], ["ts", "event_id"])
        flows.stream_merge(changes, base, target, scratch_path(spark, "ckpt"), merge, keys=keys, deltas=2).awaitTermination()
        assert rows_of(flows.latest_version(spark, target, base, keys)) == rows_of(once)


def test_scd1_merge(spark):
    source, target = scratch_path(spark, "src"), scratch_path(spark, "dim")
    spark.createDataFrame([(1, "b"), (3, "n")], "k int, v string").write.parquet(source)
    base = spark.createDataFrame([(1, "a"), (2, "c")], "k int, v string")
    stream = flows.stream_files(spark, source, "k int, v string")
    query = flows.stream_merge(stream, base, target, scratch_path(spark, "ckpt"), flows.merge_scd1(["k"], ["v"]))  # no keys: one bucket
    query.awaitTermination()
    assert rows_of(flows.latest_version(spark, target, base)) == Counter([(1, "b"), (2, "c"), (3, "n")])


def table(spark, target, base):
    return dict(tuple(r) for r in flows.latest_version(spark, target, base, ["k"]).collect())


def files(folder):
    return {(p, os.path.getmtime(p)) for p in glob.glob(f"{folder.removeprefix('file:')}/**/*.parquet", recursive=True)}


def test_merge_survives_restarts(spark):
    """Every start merges what is new, a start without input changes nothing, and superseded files can go."""
    inbox, target, checkpoint = (scratch_path(spark, n) for n in ("in", "dim", "ckpt"))
    base = spark.createDataFrame([(i, "old") for i in range(40)], "k int, v string")
    want = {i: "old" for i in range(40)}
    for rows in [[(1, "a"), (50, "b")], [(1, "c"), (2, "d")], []]:
        spark.createDataFrame(rows, "k int, v string").write.mode("append").parquet(inbox)
        stream = flows.stream_files(spark, inbox, "k int, v string")
        flows.stream_merge(stream, base, target, checkpoint, flows.merge_scd1(["k"], ["v"]), keys=["k"], buckets=16).awaitTermination()
        want.update(rows)
        assert table(spark, target, base) == want
    assert flows.drop_superseded(spark, target) == 0 and 1 <= flows.compact(spark, target, base.schema, ["k"]) <= 3
    assert flows.drop_superseded(spark, target) == 0  # the commit before the last one still names them
    assert table(spark, target, base) == want


def changes(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, at int, change string")


@pytest.fixture
def sunk(spark):
    """A table of 100 rows and a sink for change rows."""
    target = scratch_path(spark, "dim")
    base = spark.createDataFrame([(i, "old") for i in range(100)], "k int, v string")

    def sink(rows, number, **kw):
        flows.merge_sink(target, flows.merge_changes(["k"], ["at"]), base, ["k"], **{"buckets": 4, **kw})(changes(spark, rows), number)

    return target, base, sink


@pytest.mark.parametrize("deltas", [1, 2, 16])
def test_repeated_batch_after_cleaning(spark, sunk, deltas):
    """A crash between our commit and the checkpoint sends the batch again, when older files may be gone."""
    target, base, sink = sunk
    want = {i: "old" for i in range(100)}
    for number, rows in enumerate([[(7, "a", 1, "update")], [(7, None, 2, "delete"), (200, "n", 1, "insert")], [(7, "back", 3, "insert")]]):
        for _ in range(2):
            sink(rows, number, deltas=deltas)
            flows.drop_superseded(spark, target)
        for k, v, _, change in rows:
            want.pop(k, None) if change == "delete" else want.update({k: v})
        assert table(spark, target, base) == want


def test_bucket_that_becomes_empty(spark):
    target = scratch_path(spark, "dim")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sink = flows.merge_sink(target, flows.merge_changes(["k"], ["at"]), base, ["k"], buckets=2, deltas=1)
    sink(changes(spark, [(1, None, 1, "delete"), (2, None, 1, "delete")]), 0)
    assert table(spark, target, base) == {} and set(merged.read_manifest(spark, target).buckets) == {0, 1}
    sink(changes(spark, [(2, "c", 2, "insert")]), 1)
    assert table(spark, target, base) == {2: "c"}


def test_missing_files_fail(spark, sunk):
    target, base, sink = sunk
    sink([(1, "x", 1, "update")], 0)
    merged._delete(spark, f"{merged.base_path(target, 0)}/_bucket=1")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        flows.latest_version(spark, target, base, ["k"]).collect()


def test_batches_rewrite_no_base_file(spark):
    """1,000 random keys reach every bucket of a million rows; only a delta is written."""
    target = scratch_path(spark, "dim")
    base = spark.range(1_000_000).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v"))
    sink = flows.merge_sink(target, flows.merge_scd1(["k"], ["v"]), base, ["k"])
    sink(spark.createDataFrame([(1, "x")], base.schema), 0)
    before = files(merged.base_path(target, 0))
    batch = spark.range(1000).select((F.col("id") * 997).cast("int").alias("k"), F.lit("new").alias("v"))
    sink(batch, 1)
    assert files(merged.base_path(target, 0)) == before and len(merged._names(spark, target)) == 4  # base, two deltas, commits
    got = flows.latest_version(spark, target, base, ["k"]).groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {"old": 998_999, "new": 1000, "x": 1}


def test_old_commits_and_files_go(spark, sunk):
    target, base, sink = sunk
    for number in range(7):
        sink([(number, "x", number, "update")], number, deltas=3)
    assert len(merged._names(spark, f"{target}/commits")) == 2
    flows.drop_superseded(spark, target)
    state = merged.read_manifest(spark, target)
    assert len([n for n in merged._names(spark, target) if n.startswith("delta-")]) <= 3 and len(state.deltas) == 1
    assert table(spark, target, base) == {i: "x" if i < 7 else "old" for i in range(100)}


def test_other_writer_and_more_buckets(spark, sunk):
    """Another checkpoint counts from 0 again; its batches are new ones."""
    target, base, sink = sunk
    sink([(1, "a", 1, "update")], 0)
    sink([(1, "b", 2, "update")], 0, writer="other")
    assert table(spark, target, base)[1] == "b"
    assert flows.compact(spark, target, base.schema, ["k"], buckets=9) == 9
    assert table(spark, target, base) == {**{i: "old" for i in range(100)}, 1: "b"}


def test_null_keys_and_versions_of_a_key(spark):
    target = scratch_path(spark, "dim")
    schema = "k int, v string, valid_from int, valid_to int, is_current boolean"
    base = spark.createDataFrame([(1, "a", 0, None, True), (None, "z", 0, None, True)], schema)
    for number, rows in enumerate([[(1, "b")], [(1, "c"), (2, "n")], [(1, "c")]]):
        merge = flows.merge_scd2(["k"], ["v"], F.lit(number + 1))
        flows.merge_sink(target, merge, base, ["k"], buckets=3)(spark.createDataFrame(rows, "k int, v string"), number)
    got = rows_of(flows.latest_version(spark, target, base, ["k"]))
    assert got == Counter([(None, "z", 0, None, True), (1, "a", 0, 1, False), (1, "b", 1, 2, False), (1, "c", 2, None, True), (2, "n", 2, None, True)])


def test_unfinished_delta_is_not_read(spark, sunk):
    target, base, sink = sunk
    sink([(1, "x", 1, "update")], 0)
    spark.createDataFrame([(9, "half written")], base.schema).write.parquet(f"{merged.delta_path(target, 2)}/rows")
    assert table(spark, target, base)[9] == "old" and flows.drop_superseded(spark, target) == 0
    sink([(2, "y", 1, "update")], 1)
    assert table(spark, target, base) == {**{i: "old" for i in range(100)}, 1: "x", 2: "y"}
