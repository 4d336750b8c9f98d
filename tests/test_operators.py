"""Laws and brute-force checks, many of them on tables where one key holds a third of the rows."""

import json
import random
import statistics
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill import session
from rowmill.operators import aggregate as agg
from rowmill.operators import convert, dedup, extract, filtering, joins, lineage, mapping, ordered, quality, reshape, scd, sets, synth
from rowmill.operators.ordered import ordered_slices
from rowmill.session import materialize
from rowmill.types import declared_schema, spark_type


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows; key 'hot' holds a third of them, a NULL key some."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(200)}"
        rows.append((i, key, rng.randrange(1000), float(rng.randrange(500)), rng.choice(["a", "b", "c"])))
    return spark.createDataFrame(rows, "id bigint, key string, ts int, value double, state string").repartition(5).cache()


@pytest.fixture(autouse=True, scope="module")
def small_limits():
    """Groups above 100 rows count as hot, so that both ways are taken."""
    before, ordered.HOT_ROWS = ordered.HOT_ROWS, 100
    yield
    ordered.HOT_ROWS = before


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def groups(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["key"]].append(r)
    return out


# --- filters, mapping


def test_filter_and_reject_make_the_input(hot):
    ok, reject = filtering.split_rows(hot, [("key", "==", "hot"), ("value", ">", 100.0)], "OR")
    assert rows_of(ok) + rows_of(reject) == rows_of(hot)


def test_filter_operators(spark):
    df = spark.createDataFrame([("abc", 1), ("abd", 2), (None, 3)], "s string, n int")
    pick = lambda *c: sorted(r["n"] for r in filtering.filter_rows(df, c).collect())
    assert pick(("s", "MATCHES", "ab.")) == [1, 2]
    assert pick(("s", "MATCHES", "b")) == []
    assert pick(("s", "CONTAINS", "bc")) == [1]
    assert pick(("s", "STARTS_WITH", "ab"), ("n", "!=", 1)) == [2]
    assert pick(("s", "IS_NULL", None)) == [3]
    assert pick(("n", "IN", [1, 3])) == [1, 3]
    with pytest.raises(ValueError):
        filtering.predicate([("s", "~~", 1)])


def test_filter_reaches_the_scan(spark, sf):
    df = filtering.filter_rows(spark.read.parquet(f"{sf}/lineitem.parquet"), [("l_quantity", ">", 10.0)]).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_context_parameters_reach_the_scan(spark, sf):
    df = mapping.with_context(spark.read.parquet(f"{sf}/orders.parquet"), {"status": "F"})
    plan = df.where("o_orderstatus = context.status").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


def test_load_context(spark):
    rows = spark.createDataFrame([("floor", "3"), ("who", None), ("twice", "a"), ("twice", "b")], "key string, value string")
    params = mapping.load_context(rows, ["floor", "who", "twice", "absent"])
    out = mapping.with_context(spark.range(6), params).where("id > context.floor").select("id", "context.*")
    assert rows_of(out) == Counter([(4, "3", None, "b", None), (5, "3", None, "b", None)])


def test_map_columns_do_not_stop_the_sort(spark):
    df = spark.range(5).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    assert [r["n"] for r in dedup.sequence(df, "n", [("id", "desc")]).orderBy("id").collect()] == [5, 4, 3, 2, 1]


def test_unknown_column_fails(spark):
    with pytest.raises(AnalysisException):
        mapping.map_columns(spark.range(1), {"a": "missing + 1"}).collect()


def test_variables_are_computed_level_by_level(spark):
    """Independent variables share a projection; former values, whole structs and Columns keep their order."""
    many = {f"v{i}": f"id + {i}" for i in range(40)} | {"total": " + ".join(f"Var.v{i}" for i in range(40)), "last": "Var.total * 2"}
    assert [len(x) for x in mapping._variable_levels(many)] == [40, 1, 1]
    row = mapping.with_variables(spark.range(1), many).select("Var.*").first()
    assert row["total"] == sum(range(40)) and row["last"] == 2 * row["total"] and row["v39"] == 39

    first = mapping.with_variables(spark.range(1), {"a": "1", "b": "2"})
    out = mapping.with_variables(first, {"old": "Var.a", "x": "Var.old + 1", "a": "10", "seen": "Var.a", "all": "to_json(Var)", "b": F.col("Var.a") + 1, "c": "Var.b", "none": None})
    row = out.select("Var.*").first()
    assert (row["old"], row["x"], row["a"], row["seen"], row["b"], row["c"], row["none"]) == (1, 2, 10, 10, 11, 11, None)
    assert json.loads(row["all"]) == {"a": 10, "b": 2, "old": 1, "x": 2, "seen": 10}
    later = mapping.with_variables(first, {"x": "Var.b", "y": "Var.x + Var.a", "a": "100", "z": "Var.a"}).select("Var.*").first()
    assert (later["y"], later["a"], later["z"]) == (3, 100, 100)


def test_variables_see_earlier_variables(spark):
    out = mapping.map_columns(spark.range(1, 3), {"b": "Var.b"}, {"a": "id * 10", "b": "Var.a + 1"})
    assert sorted(r["b"] for r in out.collect()) == [11, 21]


def test_outputs_cover_the_input(hot):
    columns = {"id": "id"}
    outputs = mapping.map_outputs(
        hot, {"a": {"columns": columns, "where": "key = 'hot'"}, "b": {"columns": columns, "where": "key <> 'hot' AND value > 250"}, "r": {"columns": columns, "reject": True}}
    )
    assert sum((rows_of(o) for o in outputs.values()), Counter()) == rows_of(hot.select("id"))


def _three_outputs():
    columns = {"id": "id", "net": "Var.net"}
    return {
        "a": {"columns": columns, "where": "key = 'hot' AND Var.net > 100", "variables": {"net": "value * 2"}},
        "b": {"columns": columns, "where": "value > 250", "variables": {"net": "100 / nullif(value, 0)"}},
        "r": {"columns": {"id": "id", "note": ""}, "reject": True},
    }


def test_outputs_read_the_input_once(spark, hot):
    path = session.scratch_path(spark, "once")
    hot.write.parquet(path)
    plan = mapping.tag_outputs(spark.read.parquet(path), _three_outputs())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    out = {n: o.collect() for n, o in mapping.map_outputs(spark.read.parquet(path), _three_outputs()).items()}
    rows = hot.collect()
    a = {(r["id"], r["value"] * 2) for r in rows if r["key"] == "hot" and r["value"] * 2 > 100}
    b = {(r["id"], 100 / r["value"]) for r in rows if r["value"] > 250}
    assert set(out["a"]) == a and set(out["b"]) == b
    assert {r["id"] for r in out["r"]} == {r["id"] for r in rows} - {i for i, _ in a | b}
    assert all(r["note"] is None for r in out["r"])


def test_outputs_one_pass_equals_one_plan_each(spark, hot):
    columns = {"id": "id", "twice": ("value * 2", "int")}
    outputs = {"a": {"columns": columns, "where": "key = 'hot'"}, "b": {"columns": columns}, "odd name": {"columns": {"k": "key"}, "where": "key IS NULL"}, "r": {"columns": columns, "reject": True}}
    once, each = (mapping.map_outputs(hot, outputs, one_pass=w) for w in (True, False))
    assert all(rows_of(once[n]) == rows_of(each[n]) and once[n].columns == each[n].columns for n in outputs)
    empty = mapping.map_outputs(hot.limit(0), outputs)
    assert all(o.collect() == [] for o in empty.values())


def test_outputs_keep_a_column_named_var(spark):
    df = spark.createDataFrame([(1, ("x",)), (2, ("y",))], "id int, Var struct<old: string>")
    outputs = {"a": {"columns": {"id": "id", "old": "Var.old", "new": "Var.new"}, "where": "Var.new > 1", "variables": {"new": "id"}}, "r": {"columns": {"old": "Var.old"}, "reject": True}}
    out = mapping.map_outputs(df, outputs)
    assert out["a"].collect() == [(2, "y", 2)] and out["r"].collect() == [("x",)]


def test_an_output_is_evaluated_for_its_rows_only(spark):
    df = spark.createDataFrame([("1",), ("x",)], "t string")
    outputs = {"ok": {"columns": {"n": "CAST(t AS INT)"}, "where": "t RLIKE '^[0-9]+$'"}, "r": {"columns": {"t": "t"}, "reject": True}}
    out = mapping.map_outputs(df, outputs)
    assert out["ok"].collect() == [(1,)] and out["r"].collect() == [("x",)]


def test_count_loop(spark):
    df = spark.createDataFrame([(0,), (-1,), (None,), (2,), (25001,)], "n int")
    got = Counter(r["n"] for r in mapping.count_loop(df, "n").collect())
    assert got == {2: 2, 25001: 25001}
    assert mapping.count_loop(df.where("n = 25001"), "n").agg(F.min("iteration"), F.max("iteration")).first() == (1, 25001)


def test_sort_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "n int")
    assert [r["n"] for r in filtering.sort_rows(df, ["n"]).collect()] == [1, 2, None]
    assert [r["n"] for r in filtering.sort_rows(df, [("n", "desc")]).collect()] == [2, 1, None]


# --- numbering and windows over hot keys


@pytest.mark.parametrize("parts", [1, 7])
def test_sequence_has_no_gaps_and_follows_the_order(hot, parts):
    out = dedup.sequence(hot.repartition(parts), "n", ["ts", "id"], start=10, step=3).collect()
    ordered = sorted(out, key=lambda r: (r["ts"], r["id"]))
    assert [r["n"] for r in ordered] == list(range(10, 10 + 3 * len(ordered), 3))


def test_sequence_uses_no_single_partition(hot):
    plan = dedup.sequence(hot, "n", ["ts", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_slices_split_the_hot_key(hot):
    spread = ordered_slices(hot, ["key", "ts"]).where("key = 'hot'").groupBy("_slice").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 1000


@pytest.mark.parametrize("n", [1, 3, 150])
def test_first_rows_match_brute_force(hot, n):
    got = defaultdict(set)
    for r in dedup.first_rows(hot, n, ["key"], ["ts", "id"]).collect():
        got[r["key"]].add(r["id"])
    for key, rows in groups(hot).items():
        want = sorted(rows, key=lambda r: (r["ts"], r["id"]))[:n]
        assert got[key] == {r["id"] for r in want}


def test_dedup_filters_ranks_before_the_shuffle(hot):
    plan = dedup.dedup(hot, ["key"], ["ts", "id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_dedup_without_case(spark):
    df = spark.createDataFrame([("A", 2), ("a", 1), ("b", 3)], "k string, n int")
    assert sorted(r["n"] for r in dedup.dedup(df, ["k"], ["n"], case_sensitive=False).collect()) == [1, 3]
    assert sorted(r["n"] for r in dedup.dedup(df, ["k"], ["n"]).collect()) == [1, 2, 3]


def test_sequence_within(hot):
    out = groups(dedup.sequence_within(hot, "n", ["key"], ["ts", "id"]))
    for rows in out.values():
        ordered = sorted(rows, key=lambda r: (r["ts"], r["id"]))
        assert [r["n"] for r in ordered] == list(range(1, len(ordered) + 1))


@pytest.mark.parametrize("ranges", [[(1, 3), (10, 12)], [(2999, 200_000), (1, 1)]])
def test_sample_ranges(hot, ranges):
    want = {r["id"] for i, r in enumerate(sorted(hot.collect(), key=lambda r: (r["ts"], r["id"])), 1) if any(a <= i <= b for a, b in ranges)}
    assert {r["id"] for r in filtering.sample_rows(hot, ["ts", "id"], ranges).collect()} == want


@pytest.mark.parametrize("order", [[("key", "desc"), "id"], ["key", ("value", "desc")], ["state"], [("value", "desc")]])
def test_sample_ranges_find_the_rows_of_the_sorted_table(hot, order):
    ranges = [(5, 5), (700, 1300), (1200, 1250), (2990, 3005), (9, 2)]
    numbered = ordered.with_position(hot, order, "p")
    want = numbered.where("p = 5 OR p BETWEEN 700 AND 1300 OR p >= 2990").drop("p")
    assert rows_of(filtering.sample_rows(hot, order, ranges)) == rows_of(want)


def test_sample_ranges_sort_and_write_only_the_ends(spark, hot, monkeypatch):
    made = []
    monkeypatch.setattr(ordered, "materialize", lambda *a: made.append(a))
    got = filtering.sample_rows(hot, ["ts", "id"], [(100, 2500)])
    assert got.count() == 2401 and made == []


def test_sample_ranges_over_equal_rows(spark):
    """Rows that no bound can part, many more than a task is given."""
    df = spark.range(2000).selectExpr("CAST(id >= 900 AS INT) AS k")
    got = Counter(r["k"] for r in filtering.sample_rows(df, ["k"], [(890, 1000)]).collect())
    assert got == {0: 11, 1: 100}
    assert filtering.sample_rows(df, ["k"], [(2001, 2100)]).collect() == []
    assert filtering.sample_rows(df.limit(0), ["k"], [(1, 5)]).collect() == []


def test_sample_ranges_by_every_comparable_type(spark):
    rows = "SELECT id, if(id % 7 = 0, NULL, date_add(DATE'2020-01-01', CAST(id % 50 AS INT))) AS d, CAST(id % 11 AS DECIMAL(9, 2)) AS n, CAST(CAST(id % 13 AS STRING) AS BINARY) AS b, if(id % 5 = 0, double('NaN'), id / 3) AS f, id % 2 = 0 AS t, timestamp_seconds(id % 17) AS s FROM range(600)"
    df = spark.sql(rows)
    for order in (["d", "id"], [("n", "desc"), "id"], ["b", "id"], [("f", "desc"), "id"], ["t", ("s", "desc"), "id"]):
        want = ordered.with_position(df, order, "p").where("p BETWEEN 150 AND 420").select("id")
        assert rows_of(filtering.sample_rows(df, order, [(150, 420)]).select("id")) == rows_of(want), order


def test_split_hot_finds_hot_and_null_keys(hot):
    cool, large = ordered.split_hot(hot, ["key"], 30)
    counts = Counter(r["key"] for r in hot.collect())
    assert {r["key"] for r in large.select("key").distinct().collect()} == {k for k, n in counts.items() if n > 30} >= {"hot", None}
    assert rows_of(cool) + rows_of(large) == rows_of(hot)
    assert ordered.split_hot(hot, ["key"], 5000)[1] is None


@pytest.mark.parametrize("limit", [0, 10_000])
def test_results_do_not_depend_on_the_limit(hot, monkeypatch, limit):
    calls = (
        lambda: scd.history_from_log(hot, ["key"], "ts", ["state"], ["id"]),
        lambda: agg.aggregate(hot, ["key"], [("value", "median", "m"), ("state", "list", "l")], order_by=["ts", "id"]),
        lambda: dedup.sequence_within(hot, "n", ["key"], ["ts", "id"]),
        lambda: dedup.first_rows(hot, 120, ["key"], ["ts", "id"]),
    )
    want = [rows_of(c()) for c in calls]
    monkeypatch.setattr(ordered, "HOT_ROWS", limit)
    assert [rows_of(c()) for c in calls] == want


def test_hot_main_key_is_split_beside_a_reduced_lookup(spark, hot):
    ref = hot.select(F.col("key").alias("rk"), "ts", "id")
    for df in (joins.lookup_reject(hot, ref, {"rk": "key"}), joins.lookup(hot, ref, {"rk": "key"}, "left", "first", ["ts", "id"])):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert physical.count("Exchange hashpartitioning") + physical.count("BroadcastExchange") >= 2, plan


# --- aggregates


def test_median_matches_brute_force(hot):
    got = {r["key"]: r["m"] for r in agg.aggregate(hot, ["key"], [("value", "median", "m")]).collect()}
    assert got == {k: statistics.median([r["value"] for r in rows]) for k, rows in groups(hot).items()}


def test_median_ways_agree_and_skip_nulls(hot):
    holes = hot.withColumn("value", F.when(F.col("state") != "a", F.col("value")))
    ops = [("value", "median", "m"), ("id", "count", "n")]
    assert rows_of(agg.aggregate(holes, ["key"], ops)) == rows_of(agg.aggregate(holes, ["key"], ops, gather="memory"))
    assert agg.aggregate(holes, [], ops).first() == agg.aggregate(holes, [], ops, gather="memory").first()


def test_median_by_bits_of_any_number(spark):
    """Signs, zeros, infinities, NaN, subnormal and far apart numbers; even and odd sizes; NULL and hot keys."""
    rng = random.Random(3)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan"), 1e-300, 0.1 + 0.2, 0.3]
    rows = [(k, rng.choice(odd) if rng.random() < 0.3 else rng.uniform(-1, 1) * 10 ** rng.randrange(-5, 300)) for k in ("a", "b", None) for _ in range(201 + (k == "b"))]
    rows += [("inf", float("inf"))] * 150 + [("huge", 1.7e308)] * 150 + [("two", -3.0)] * 75 + [("two", 8.0)] * 75
    df = spark.createDataFrame(rows, "key string, value double")
    ops = [("value", "median", "m")]
    for keys in (["key"], []):
        sliced, plain = (agg.aggregate(df, keys, ops, gather=g) for g in ("sliced", "memory"))
        assert sorted(map(repr, sliced.collect())) == sorted(map(repr, plain.collect()))


def test_median_by_bits_moves_counts_only(spark, hot):
    rows = hot.select("key", F.col("value").alias("_value"))
    plan = agg.middle_by_bits(rows, ["key"], "_value", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Relation" in plan


def test_median_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, value double")
    assert agg.aggregate(empty, ["key"], [("value", "median", "m")]).collect() == []
    assert agg.aggregate(empty, [], [("value", "median", "m"), ("value", "count", "n")]).first() == (None, 0)


def test_list_ways_agree(hot):
    ops = [("state", "list", "s"), ("value", "sum", "v")]
    a = agg.aggregate(hot, ["key"], ops, order_by=["ts", "id"])
    b = agg.aggregate(hot, ["key"], ops, order_by=["ts", "id"], gather="memory")
    assert rows_of(a) == rows_of(b)


def test_first_and_last_need_an_order(hot):
    with pytest.raises(ValueError):
        agg.aggregate(hot, ["key"], [("value", "first", "f")])
    with pytest.raises(ValueError):
        agg.aggregate(hot, ["key"], [("value", "magic", "f")])


def test_normalize_undoes_denormalize(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c"), ("x", "a")], "key string, item string")
    joined = agg.denormalize(df, ["key"], "item", ";", dedup=True)
    assert {tuple(r) for r in joined.collect()} == {("x", "a;b"), ("y", "c")}
    assert rows_of(reshape.normalize(joined, "item", ";")) == rows_of(df.distinct())


def test_denormalize_parts_join_to_the_whole(hot):
    parts = agg.denormalize_parts(hot, ["key"], "state", ";", ["ts", "id"]).collect()
    assert max(r["part"] for r in parts if r["key"] == "hot") > 1
    whole = defaultdict(list)
    for r in sorted(parts, key=lambda r: r["part"]):
        whole[r["key"]].append(r["state"])
    want = {r["key"]: r["state"] for r in agg.denormalize(hot, ["key"], "state", ";", order_by=["ts", "id"]).collect()}
    assert {k: ";".join(v) for k, v in whole.items()} == want


def test_normalize_edge_cases(spark):
    df = spark.createDataFrame([(1, "a, ,b"), (2, ""), (3, None), (4, "x")], "id int, item string")
    got = [(r["id"], r["item"]) for r in reshape.normalize(df, "item").collect()]
    assert sorted(got) == [(1, ""), (1, "a"), (1, "b"), (2, ""), (4, "x")]
    got = [(r["id"], r["item"]) for r in reshape.normalize(df, "item", drop_empty=True, keep_null=True).collect()]
    assert Counter(got) == Counter([(1, "a"), (1, "b"), (2, None), (3, None), (4, "x")])


def test_flow_meter(hot):
    metered, meter = agg.flow_meter(hot.where("key = 'hot'"))
    metered.write.format("noop").mode("overwrite").save()
    assert meter.get["rows"] == 1000


def test_pivot_and_unpivot(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "a", 2), ("x", None, 5), ("y", "b", 3)], "k string, p string, v int")
    wide = reshape.pivot(df, ["k"], "p", "v", "sum", {"a": "va", "b": "vb", None: "vn"})
    assert {tuple(r) for r in wide.collect()} == {("x", 3, None, 5), ("y", None, 3, None)}
    long = reshape.unpivot(wide, ["k"], ["va", "vb"], "name", "v")
    assert rows_of(long.where("v IS NOT NULL")) == Counter([("x", "va", 3), ("y", "vb", 3)])


# --- joins


def test_full_lookup_matches_the_built_in_join(spark, hot):
    ref = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zzz", 4), (None, 5)], "rk string, r int")
    got = joins.lookup(hot.select("id", "key"), ref, {"rk": "key"}, "full")
    want = hot.select("id", "key").join(ref, F.col("rk") == F.col("key"), "full")
    assert rows_of(got) == rows_of(want)


def test_match_modes(spark):
    main = spark.createDataFrame([(1,), (2,)], "k int").alias("row1")
    ref = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, None, None)], "rk int, v string, o int")
    pick = lambda m: {tuple(r) for r in joins.lookup(main, ref, {"rk": "row1.k"}, "left", m, ["o"]).select("k", "v").collect()}
    assert pick("first") == {(1, "b"), (2, None)}
    assert pick("unique") == {(1, None), (2, None)}
    with pytest.raises(ValueError):
        joins.lookup(main, ref, {"rk": "row1.k"}, match="first")


def test_keyless_lookup_takes_small_tables_only(spark, monkeypatch):
    left, right = spark.range(50), spark.range(7).withColumnRenamed("id", "other")
    out = joins.keyless_lookup(left, right)
    assert rows_of(out) == Counter((a, b) for a in range(50) for b in range(7))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows_of(joins.iterate_params(left, right, "id = param.other * 2")) == Counter((2 * b, b) for b in range(7))
    assert joins.keyless_lookup(left, right.limit(0)).count() == 0
    monkeypatch.setattr(joins, "SMALL_ROWS", 6)
    for call in (joins.keyless_lookup, joins.iterate_params):
        with pytest.raises(ValueError):
            call(left, right)


def test_right_lookup_with_a_hot_key_splits(spark):
    """The main side of a right lookup is joined by an inner join, which adaptive execution can split."""
    main = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k int, i int").alias("row1")
    ref = spark.createDataFrame([(k, f"v{k}") for k in (1, 3, 1000, None)], "rk int, v string")
    out = joins.lookup(main, ref, {"rk": "row1.k"}, "right")
    assert "RightOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = Counter((1, i, 1, "v1") for i in range(300) if i % 3) + Counter([(3, 3, 3, "v3"), (None, None, 1000, "v1000"), (None, None, None, "vNone")])
    assert rows_of(out) == want


def test_locate_ip_in_ranges_of_any_width(spark):
    import random as r

    rng = r.Random(3)
    ranges = [(0, 2**32 - 1, "all"), (0, 0, "first"), (2**32 - 1, 2**32 - 1, "last"), (5, 4, "none"), (255, 256, "two")]
    ranges += [(a, min(2**32 - 1, a + rng.choice([0, 1, 2, 255, 256, 70_000, 2**31])), f"r{i}") for i, a in enumerate(rng.randrange(2**32) for _ in range(60))]
    ips = [0, 255, 256, 257, 2**32 - 1, *(rng.randrange(2**32) for _ in range(40)), *(x for lo, hi, _ in ranges[5:15] for x in (lo, hi))]
    dotted = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    df = spark.createDataFrame([(dotted(x),) for x in ips] + [("300.1.1.1",), (None,)], "a string")
    got = rows_of(joins.locate_ip(df, "a", spark.createDataFrame(ranges, "lo bigint, hi bigint, name string"), "lo", "hi", ["name"]))
    want = Counter((dotted(x), n) for x in ips for lo, hi, n in ranges if lo <= x <= hi) + Counter([("300.1.1.1", None), (None, None)])
    assert got == want


def test_locate_ip_over_blocks(spark, monkeypatch):
    """Runs of many blocks, equal bounds, repeated rows and ranges, addresses spelled twice, NULL bounds, empty tables."""
    monkeypatch.setattr(joins, "_BLOCK", 4)
    monkeypatch.setattr(joins, "_BLOCKS", 2)
    ranges = [(0, 300, "all"), (0, 300, "all"), (10, 10, "one"), (50, 99, "b"), (50, 120, None), (None, 5, "n"), (5, None, "n"), (400, 500, "none")]
    ips = [(f"0.0.{n // 256}.{n % 256}",) for n in range(0, 310, 3)] + [("0.0.0.9",), ("0.0.0.010",), (None,)]
    df, table = spark.createDataFrame(ips, "a string"), spark.createDataFrame(ranges, "lo bigint, hi bigint, name string")
    want = Counter()
    for (ip,) in ips:
        n = None if ip is None else int(joins_number(ip))
        hits = [name for lo, hi, name in ranges if None not in (n, lo, hi) and lo <= n <= hi]
        want.update((ip, name) for name in hits or [None])
    assert rows_of(joins.locate_ip(df, "a", table, "lo", "hi", ["name"])) == want
    assert rows_of(joins.locate_ip(df, "a", table.limit(0), "lo", "hi", ["name"])) == Counter((ip, None) for (ip,) in ips)
    assert joins.locate_ip(df.limit(0), "a", table, "lo", "hi", ["name"]).count() == 0


def joins_number(ip):
    return sum(int(p) * 256**i for i, p in enumerate(reversed(ip.split("."))))


words = st.text(alphabet="abc", min_size=0, max_size=5)


@settings(max_examples=8, deadline=None)
@given(st.lists(words, min_size=1, max_size=12), st.lists(words, min_size=1, max_size=12), st.integers(0, 2))
def test_fuzzy_lookup_finds_exactly_the_near_pairs(spark, left, right, limit):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            row, old = [i], row
            for j, cb in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (ca != cb)))
        return row[-1]

    main = spark.createDataFrame(list(enumerate(left)), "i int, a string")
    ref = spark.createDataFrame(list(enumerate(right)), "j int, b string")
    got = Counter((r["i"], r["j"], r["distance"]) for r in joins.fuzzy_lookup(main, ref, "a", "b", limit).collect())
    want = Counter((i, j, distance(a, b)) for i, a in enumerate(left) for j, b in enumerate(right) if distance(a, b) <= limit)
    assert got == want


def edited(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text) + 1)
        text = rng.choice([text[:i] + "z" + text[i:], text[:i] + text[i + 1:], text[:i] + "y" + text[i + 1:]])
    return text


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_fuzzy_candidates_miss_no_near_pair(spark, k):
    """Texts on both sides of the size from which they meet on parts, edited anywhere, also in runs of one character."""
    rng = random.Random(k)
    border = joins._short_size(k)
    right = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 2, k, border - 1, border, border + 1, border + k, 70, 71, 150, 400) for _ in range(4)]
    right += ["a" * border, "a" * (border + 1), "ab" * 60]
    left = [edited(rng, rng.choice(right), rng.randrange(k + 1)) for _ in range(150)]
    main, ref = (spark.createDataFrame([(t,) for t in set(x)], c) for x, c in ((left, "_a string"), (right, "_b string")))
    near = lambda df: {(r["_a"], r["_b"]) for r in df.where(F.levenshtein("_a", "_b") <= k).collect()}
    assert near(joins.fuzzy_candidates(main, ref, k)) == near(main.crossJoin(ref))


def test_fuzzy_parts_that_all_texts_share(spark):
    """A beginning common to all texts, short or long, leaves few pairs to compare."""
    n = 3000
    for label in ("Customer#%09d", "x" * 100 + " Customer#%09d " + "y" * 40):
        ref = spark.range(n).select(F.format_string(label, "id").alias("_b"))
        main = ref.select(F.expr("concat(substr(_b, 1, length(_b) - 1), 'q')" if len(label) < 50 else "concat('q', _b)").alias("_a")).distinct()
        met = joins.fuzzy_candidates(main, ref, 1).count()
        assert n <= met <= 100 * n


def test_locate_ip_matches_brute_force(spark):
    rng = random.Random(3)
    bounds, low = [], 0
    for i in range(40):
        low += rng.randrange(1, 2000)
        high = low + rng.choice([0, 3, 255, 256, 5000])
        bounds.append((low, high, i))
        low = high + 1
    numbers = [rng.randrange(0, low + 100) for _ in range(300)] + [bounds[0][0]] * 100
    text = [".".join(str(n >> s & 255) for s in (24, 16, 8, 0)) for n in numbers] + ["1.2.3", None, "300.1.1.1"]
    df = spark.createDataFrame(list(enumerate(text)), "i int, ip string")
    out = joins.locate_ip(df, "ip", spark.createDataFrame(bounds, "lo bigint, hi bigint, place int"), "lo", "hi", ["place"])
    got = {r["i"]: r["place"] for r in out.collect()}
    want = {i: next((p for a, b, p in bounds if a <= n <= b), None) for i, n in enumerate(numbers)}
    assert got == {**want, 400: None, 401: None, 402: None}


# --- sets


def test_intersect_matches_the_built_in(hot):
    a, b = hot.select("key", "state"), hot.where("value > 400").select("key", "state")
    assert rows_of(sets.intersect(a, b)) == rows_of(a.intersect(b))


@pytest.mark.parametrize("block", [7, 100_000])
def test_intersect_all_matches_the_built_in(hot, monkeypatch, block):
    monkeypatch.setattr(sets, "COPIES", block)
    a, b = hot.select("key", "state"), hot.where("value > 400").select("key", "state")
    assert rows_of(sets.intersect(a, b, all=True)) == rows_of(a.intersectAll(b))


def test_unite_counts(hot):
    assert sets.unite([hot, hot, hot]).count() == 9000


# --- conversion


def test_convert_and_reject_make_the_input(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("2.0",)], "v string")
    ok, reject = convert.convert_types(df, {"v": "int"})
    assert sorted(r["v"] for r in reject.collect()) == ["2.0", "x"]
    assert Counter(r["v"] for r in ok.collect()) == Counter([1, None])


def test_schema_check_codes(spark):
    schema = declared_schema(
        [{"name": "a", "type": "id_Integer", "nullable": False}, {"name": "b", "type": "id_String", "length": 2}, {"name": "c", "type": "id_Date"}]
    )
    df = spark.createDataFrame([("1", "xy", "2024-01-01"), ("q", "xyz", "nope"), (None, None, None)], "a string, b string, c string")
    ok, reject = convert.schema_check(df, schema)
    assert [f.dataType for f in ok.schema.fields] == [T.IntegerType(), T.StringType(), T.DateType()]
    assert ok.count() == 1
    assert {r["a"]: r["errorCode"] for r in reject.collect()} == {"q": 5, None: 2}


def test_declared_types():
    assert spark_type("id_BigDecimal", 10, 2) == T.DecimalType(10, 2)
    assert spark_type("id_BigDecimal") == T.DecimalType(18, 3)
    assert spark_type("id_Unheard") == T.StringType()


def test_replace_values_treats_plain_text_as_text(spark):
    df = spark.createDataFrame([("a.b a.bc A.B",)], "s string")
    run = lambda **k: convert.replace_values(df, [convert.Replacement("s", "a.b", "$1", **k)]).first()["s"]
    assert run() == "$1 $1c A.B"
    assert run(whole_word=True) == "$1 a.bc A.B"
    assert run(ignore_case=True) == "$1 $1c $1"


def test_masks(spark):
    df = spark.createDataFrame([("Ab-12345", "Ab-12345", "abc", None)], "a string, b string, c string, d string")
    row = convert.mask(df, {"a": "mask", "b": "keep_last4", "c": "keep_last4", "d": "hash"}).first()
    assert tuple(row) == ("Xx-nnnnn", "****2345", "abc", None)


def test_extract_regex_null_when_nothing_matches(spark):
    df = spark.createDataFrame([("k=1",), ("none",), (None,)], "s string")
    got = extract.extract_regex(df, "s", "(\\w)=(\\d)", ["k", "v"]).collect()
    assert [(r["k"], r["v"]) for r in got] == [("k", "1"), (None, None), (None, None)]


def test_extract_json_loop(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 1}, {"b": null}]}'), (2, '{"a": []}'), (3, "broken")], "id int, j string")
    got = Counter((r["id"], r["b"]) for r in extract.extract_json(df, "j", {"b": "$.b"}, "$.a").collect())
    assert got == Counter([(1, "1"), (1, None)])


# --- dimensions


def test_scd2_intervals_do_not_overlap(spark):
    dim = spark.createDataFrame([(1, 1, "a", 10, "2024-01-01", None, True)], "sk int, k int, v string, extra int, valid_from string, valid_to string, is_current boolean")
    for day, rows in (("2024-02-01", [(1, "b"), (2, "x")]), ("2024-03-01", [(1, "b"), (2, "y")]), ("2024-04-01", [(1, None), (3, "z")])):
        updates = spark.createDataFrame(rows, "k int, v string")
        dim = materialize(scd.scd2(dim, updates, ["k"], ["v"], F.lit(day), surrogate="sk"))
    rows = [r.asDict() for r in dim.collect()]
    assert len({r["sk"] for r in rows}) == len(rows) == 6
    for k in (1, 2, 3):
        mine = sorted((r for r in rows if r["k"] == k), key=lambda r: r["valid_from"])
        assert [r["is_current"] for r in mine] == [False] * (len(mine) - 1) + [True]
        assert all(a["valid_to"] == b["valid_from"] for a, b in zip(mine, mine[1:])) and mine[-1]["valid_to"] is None
    assert {r["extra"] for r in rows if r["k"] == 1} == {10}
    assert [r["v"] for r in sorted((r for r in rows if r["k"] == 1), key=lambda r: r["valid_from"])] == ["a", "b", None]


def test_history_matches_brute_force(hot):
    got = Counter(
        (r["key"], r["state"], r["valid_from"], r["valid_to"], r["is_current"])
        for r in scd.history_from_log(hot, ["key"], "ts", ["state"], ["id"]).collect()
    )
    want = Counter()
    for key, rows in groups(hot).items():
        rows = sorted(rows, key=lambda r: (r["ts"], r["id"]))
        starts = [r for i, r in enumerate(rows) if i == 0 or rows[i - 1]["state"] != r["state"]]
        for i, r in enumerate(starts):
            end = starts[i + 1]["ts"] if i + 1 < len(starts) else None
            want[(key, r["state"], r["ts"], end, i + 1 == len(starts))] += 1
    assert got == want


def test_apply_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    feed = spark.createDataFrame([(1, "x", "u", 1), (1, "y", "U", 2), (2, None, "d", 1), (4, "n", "I", 1), (5, "n", "I", 1), (5, None, "D", 2)], "k int, v string, op string, seq int")
    out = scd.apply_changes(base, scd.read_change_feed(feed, "op"), ["k"], ["seq"])
    assert rows_of(out) == Counter([(1, "y"), (3, "c"), (4, "n")])


# --- quality


def test_validate_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "a_key int, b string")
    got = {r["check"]: (r["status"], r["detail"]) for r in quality.validate(empty, "m", inner_joins=4).collect()}
    assert set(got) == {"Row Count", "Schema"} and got["Row Count"][0] == "fail" and "4 inner joins" in got["Row Count"][1]
    one = quality.validate(spark.createDataFrame([(1, None)], "a_key int, b string"), "m", null_columns=["b"]).collect()
    assert {r["check"]: r["status"] for r in one} == {"Row Count": "warn", "Schema": "pass", "NULL Analysis": "pass", "Key Uniqueness": "pass", "Code Markers": "pass"}


def test_marker_in_any_row_is_found(spark):
    rows = [(i, "fine") for i in range(500)] + [(500, "globalMap.get('x')")]
    got = {r["check"]: r["status"] for r in quality.validate(spark.createDataFrame(rows, "id int, s string"), "m").collect()}
    assert got["Code Markers"] == "fail"


def test_pick_key():
    assert quality.pick_key(["di_key", "name", "cust_id"]) == "cust_id"
    assert quality.pick_key(["di_x", "name"]) == "name"
    assert quality.pick_key(["a_key", "b_key"], null_columns=["a_key"]) == "b_key"


def test_assert_rows(spark):
    df = spark.range(5)
    assert quality.assert_rows(df, "id >= 0").count() == 5
    with pytest.raises(PySparkException):
        quality.assert_rows(df, "id < 4", "too large").count()


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k int, v string")
    assert rows_of(quality.compare(a, b, ["k"])) == Counter([(2, "changed", "v"), (3, "only_left", ""), (4, "only_right", "")])
    assert quality.compare(a, a, ["k"]).count() == 0 and quality.compare_bag(a, a).count() == 0


def test_compare_reports_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (2, "z"), (3, None)], "k int, v string")
    assert rows_of(quality.compare(a, b, ["k"])) == Counter([(1, "repeated", ""), (2, "repeated", "")])


# --- synthetic rows


def test_synth_is_the_same_for_any_partitioning(spark):
    schema = T.StructType([T.StructField("cust_id", T.LongType(), False), T.StructField("city", T.StringType()), T.StructField("amount", T.DecimalType(10, 2)), T.StructField("at", T.TimestampType())])
    base = spark.range(500)
    assert rows_of(synth.synth(base.repartition(1), schema, F.col("id"))) == rows_of(synth.synth(base.repartition(9), schema, F.col("id")))
    rows = synth.synth_table(spark, schema, 2000).collect()
    assert sorted(r["cust_id"] for r in rows) == list(range(1, 2001))
    nulls = sum(r["city"] is None for r in rows) / 2000
    assert 0.02 < nulls < 0.09 and {r["city"] for r in rows} - {None} == set(synth.CITIES)


def test_every_text_rule_gives_text(spark):
    names = [parts[0] for parts, _ in synth.TEXT_RULES]
    schema = T.StructType([T.StructField(n, T.StringType(), False) for n in names])
    row = synth.synth_table(spark, schema, 3).first()
    assert all(v is not None for v in row)


def test_patch_foreign_key(spark):
    parent = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k string")
    child = spark.createDataFrame([(i, "zz") for i in range(5)], "id int, ref string")
    got = [r["ref"] for r in synth.patch_foreign_key(parent, "k", child, "ref", ["id"]).orderBy("id").collect()]
    assert got == ["a", "b", "a", "b", "a"]
    assert [r["ref"] for r in synth.patch_foreign_key(parent, "k", child, "ref", ["id"], pool=1).collect()] == ["a"] * 5
    assert [r["ref"] for r in synth.patch_foreign_key(parent, "k", child, "ref", ["id"], pool=None).orderBy("id").collect()] == got
    kept = child.unionAll(spark.createDataFrame([(9, "b")], child.schema))
    assert rows_of(synth.patch_foreign_key(parent, "k", kept, "ref", ["id"])) == rows_of(kept)
    none = synth.patch_foreign_key(parent.where("false"), "k", child, "ref", ["id"])
    assert rows_of(none) == rows_of(child)


def test_reconcile_and_unique_columns(spark):
    out = synth.reconcile(spark.createDataFrame([(1,)], "A int"), ["a", "b", "B"])
    assert out.columns == ["A", "b"]
    fields = synth.unique_columns(T.StructType.fromDDL("a int, b int").add("A", "string"))
    assert fields.names == ["a", "b"]


# --- lineage


def test_tables_in_sql(spark):
    sql = "select * from `Db`.Orders o&#10;JOIN\\nx.y.Lines l on 1=1 left join&#9;\"q\" where z in (SELECT a FROM dual) from orders"
    got = spark.createDataFrame([(sql,), (None,), ("",)], "s string").select(lineage.tables_in_sql(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in got] == [["orders", "lines"], None, []]


def test_needed_jobs_with_cycle(spark):
    access = spark.createDataFrame(
        [("a", "write", "t1"), ("b", "read", "t1"), ("b", "write", "t2"), ("c", "read", "t2"), ("c", "write", "t1"), ("d", "write", "t9"), ("e", "read", "t9")],
        "job string, access string, table_name string",
    )
    roots = spark.createDataFrame([("c",)], "job string")
    assert sorted(r["job"] for r in lineage.needed_jobs(access, roots).collect()) == ["a", "b", "c"]
    jobs = {r["job"]: r["status"] for r in lineage.classify_jobs(access, access, roots).collect()}
    assert jobs == {"a": "data_dependent", "b": "data_dependent", "c": "connected", "d": "dead", "e": "dead"}


def test_levels_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "y"), ("z", "w")], "src string, dst string")
    nodes = spark.createDataFrame([("lone",)], "node string")
    got = {r["node"]: r["level"] for r in lineage.levels(nodes, edges).collect()}
    assert got == {"lone": 0, "a": 0, "b": 1, "c": 2, "d": 3, "x": 0, "y": None, "z": None, "w": None}
    assert lineage.max_depth(nodes, edges).first()["max_depth"] == 3


def test_deep_chain(spark, monkeypatch):
    monkeypatch.setattr(lineage, "_MAX_PARTS", 2)
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    nodes = spark.createDataFrame([("n0",)], "node string")
    assert {r["node"]: r["level"] for r in lineage.levels(nodes, edges).collect()} == {f"n{i}": i for i in range(7)}


def test_fuzzy_lookup_with_equal_column_names(spark):
    main = spark.createDataFrame([(1, "abc")], "id int, name string").alias("row1")
    ref = spark.createDataFrame([(9, "abd")], "id int, name string")
    out = joins.fuzzy_lookup(main, ref, "row1.name", "name").select("row1.id", F.col("lookup.id").alias("other"), "distance")
    assert [tuple(r) for r in out.collect()] == [(1, 9, 1)]


def test_classify_longest_suffix(spark):
    exact = spark.createDataFrame([("AXInput", "E")], "name string, class string")
    suffix = spark.createDataFrame([("put", "S"), ("Input", "L")], "suffix string, class string")
    df = spark.createDataFrame([("AXInput",), ("BInput",), ("Output",), ("zzz",), (None,), ("BInput",)], "n string")
    assert Counter(r["behavior"] for r in lineage.classify(df, "n", exact, suffix, "?").collect()) == Counter(["E", "L", "L", "S", "?", "?"])


def test_classify_repeated_names(spark):
    df = spark.createDataFrame([("a",), ("xb",)], "n string")
    exact = spark.createDataFrame([("a", "Z"), ("a", "E")], "name string, class string")
    suffix = spark.createDataFrame([("b", "Y"), ("b", "S")], "suffix string, class string")
    assert rows_of(lineage.classify(df, "n", exact, suffix, "?")) == Counter([("a", "E"), ("xb", "S")])
    none = suffix.limit(0)
    assert rows_of(lineage.classify(df, "n", exact, none, "?")) == Counter([("a", "E"), ("xb", "?")])


def test_levels_of_random_graphs(spark):
    """Lines, joins, several edges behind one line, cycles of one and more, against a walk over the whole graph."""
    rng = random.Random(8)
    for size, count in ((30, 35), (60, 60), (40, 90)):
        links = {(rng.randrange(size), rng.randrange(size)) for _ in range(count)}
        links = {(a, b) for a, b in links if a < b or rng.random() < 0.06}
        names = set(range(size)) | {900}
        want = {}
        while True:
            ready = {n for n in names - set(want) if all(a in want for a, b in links if b == n)}
            if not ready:
                break
            want.update({n: max((want[a] + 1 for a, b in links if b == n), default=0) for n in ready})
        df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links] * 2, "src string, dst string")
        got = {r["node"]: r["level"] for r in lineage.levels(spark.createDataFrame([(f"n{n}",) for n in names], "node string"), df).collect()}
        assert got == {f"n{n}": want.get(n) for n in names}


def test_levels_of_a_long_path_take_few_rounds(spark, monkeypatch):
    n, written = 10_000, []
    real = lineage.materialize
    monkeypatch.setattr(lineage, "materialize", lambda df, label: written.append(label) or real(df, label))
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    out = lineage.levels(edges.select("src").limit(0), edges)
    assert out.where(F.col("level") == F.col("node")).count() == n + 1
    assert len(written) < 30


def test_needed_jobs_shuffles_the_frontier_only(spark, monkeypatch):
    """Hot tables and jobs, cycles and NULL names; no exchange over the stored sides in a round."""
    rng = random.Random(6)
    rows = [(f"j{rng.randrange(60)}", rng.choice(["read", "write"]), rng.choice(["hot", *[f"t{i}" for i in range(40)]])) for _ in range(150)]
    rows += [("j1", "read", None), (None, "write", "t1"), ("self", "read", "s"), ("self", "write", "s")]
    want, grown = {"j1", "self"}, True
    while grown:
        tables = {t for j, a, t in rows if a == "read" and j in want and t}
        more = {j for j, a, t in rows if a == "write" and t in tables}
        grown, want = not more <= want, want | more
    access = spark.createDataFrame(rows, "job string, access string, table_name string")
    roots = spark.createDataFrame([("j1",), ("self",)], "job string")
    for hot in (session.HOT_KEY, 3):
        monkeypatch.setattr(session, "HOT_KEY", hot)
        got = lineage.needed_jobs(access, roots)
        assert {r.job for r in got.collect()} == want and got.count() == len(want)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with session.StoredBy(spark) as store:
            reads = store.write(access.where("access = 'read'").select("job", "table_name"), "job", "r")
            writes = store.write(access.where("access = 'write'").select("table_name", "job"), "table_name", "w")
            plan = lineage.round_writers(roots, reads, writes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Frontier and tables are dealt out, twice for a distinct; each stored side is read in its buckets.
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning") == 4
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rowmill_")]


def test_reads_writes_are_grouped_in_tasks_that_do_not_grow(spark, monkeypatch):
    """Two hundred long texts in tasks of 20 rows: parsed where their job lies, dealt out once, no join on the text."""
    monkeypatch.setattr(lineage, "TASK_ROWS", 20)
    jobs = spark.range(200).select(F.concat(F.lit("j"), F.col("id") % 70).alias("job"), F.concat(F.lit("select * from dw.T"), F.col("id") % 9, F.lit(" join Codes")).alias("query"))
    parts = jobs.select("job", F.lit("SQL_EXEC").alias("kind"), F.lit(None).cast("string").alias("table_name"), "query")
    other = [("j1", "DATA_SINK", '"a"."Out"', "select * from ignored"), ("j1", "DATA_SOURCE", "`in`", "select 1 from b.In2"), ("j1", "DATA_SOURCE", "", None), ("j2", "OTHER", "x", "select 1 from x"), (None, "DATA_SOURCE", "in", None)]
    got = lineage.job_reads_writes(parts.unionAll(spark.createDataFrame(other, parts.schema)))
    want = {(f"j{i % 70}", "read", t) for i in range(200) for t in (f"t{i % 9}", "codes")} | {("j1", "write", "out"), ("j1", "read", "in"), ("j1", "read", "in2"), (None, "read", "in")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    # 203 used rows in tasks of 20.
    assert plan.count("Exchange") == 1 and "hashpartitioning(job" in plan and ", 11)" in plan and "Join" not in plan
    assert rows_of(got) == Counter(want)
    links = lineage.table_links(got)._jdf.queryExecution().executedPlan().toString()
    assert links.count("Exchange") == 2


def test_a_round_does_not_sort_the_stored_rows(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with session.StoredBy(spark) as store:
            stored = store.write(spark.range(95).select((F.col("id") % 50).alias("k"), "id"), "k", "b")
            plan = stored.matched(spark.range(3).toDF("k"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortMergeJoin", "") and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("size", [250_000, 7])
def test_data_edges_of_large_tables_in_blocks(spark, monkeypatch, size):
    """Many writers, many readers, both, repeated rows and NULL names: every block of writers meets every block of readers."""
    monkeypatch.setattr(lineage, "TASK_ROWS", size)
    rows = [(f"w{i}", "write", t) for i in range(20) for t in ("many", "written", "only")] + [(f"r{i}", "read", t) for i in range(30) for t in ("many", "read", "none")]
    rows += [("w0", "read", "many"), ("one", "read", "written"), ("one", "write", "read"), ("w1", "write", "many"), ("w1", "write", None), ("r1", "read", None), (None, "read", "many")]
    access = spark.createDataFrame(rows, "job string, access string, table_name string")
    want = Counter((w, r, t) for w, a, t in rows for r, b, u in rows if a == "write" and b == "read" and t == u and t and w and r and w != r)
    assert rows_of(lineage.data_edges(access)) == want


def test_dead_jobs_read_the_components_once(spark, monkeypatch):
    stored = []
    real = lineage.materialize
    monkeypatch.setattr(lineage, "materialize", lambda df, label: stored.append(df) or real(df, label))
    rows = [("a", "write", "t"), ("b", "read", "t"), ("c", "write", "u"), ("a", "write", "t")]
    access = spark.createDataFrame(rows, "job string, access string, table_name string")
    access = access.withColumn("job", F.concat("job", F.lit("_")))
    got = lineage.classify_jobs(access, None, spark.createDataFrame([("b_",)], "job string"))
    assert rows_of(got) == Counter([("a_", "data_dependent"), ("b_", "connected"), ("c_", "dead")])
    assert "concat" not in got._jdf.queryExecution().optimizedPlan().toString().lower() and len(stored) == 2


def test_large_tables_are_stored_in_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(session, "BUCKET_ROWS", 10)
    with session.StoredBy(spark) as store:
        stored = store.write(spark.range(95).select((F.col("id") % 50).alias("k"), "id"), "k", "b")
        described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {store.names[0]}").collect()}
        assert described["Num Buckets"] == "10"
        assert rows_of(stored.matched(spark.range(3).toDF("k"))) == Counter((i % 50, i) for i in range(95) if i % 50 < 3)


def test_table_links_count_pairs_without_making_them(spark):
    jobs = spark.range(10_000)
    hot = jobs.select(F.concat(F.lit("w"), "id").alias("job"), F.lit("write").alias("access"), F.lit("hot").alias("table_name"))
    hot = hot.unionAll(jobs.select(F.concat(F.lit("r"), "id"), F.lit("read"), F.lit("hot")))
    few = spark.createDataFrame([("a", "write", "t"), ("a", "read", "t"), ("b", "read", "t"), ("b", "read", "t"), ("a", "write", "only"), ("s", "write", "s"), ("s", "read", "s")], "job string, access string, table_name string")
    assert rows_of(lineage.table_links(hot.unionAll(few))) == Counter([("hot", 10_000, 10_000, 100_000_000), ("t", 1, 2, 1)])


def test_cycles_leave_out_what_is_behind(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "t"), ("t", "u"), ("x", "x")], "src string, dst string")
    assert rows_of(lineage.cycles(edges)) == Counter([("a",), ("b",), ("x",)])


@pytest.mark.parametrize("limit", [None, 0])
def test_lists_and_first_rows_do_not_depend_on_group_size(spark, limit):
    rows = [("g", None, "y"), ("g", 1, "b"), ("g", None, "a"), ("g", 1, "a"), ("g", 2, None), ("n", 1, None), ("n", None, None), (None, 5, "k")]
    df = spark.createDataFrame(rows, "g string, k int, v string")
    out = agg.aggregate(df, ["g"], [("v", "list", "vs")], ["k"], hot_rows=limit)
    assert rows_of(out) == Counter([("g", "a,b,a,y"), ("n", None), (None, "k")])
    both = agg.aggregate(df, ["g"], [("v", "list", "vs"), ("k", "median", "m"), ("v", "first", "f"), ("v", "last", "l")], ["k"], hot_rows=limit)
    assert rows_of(both) == Counter([("g", "a,b,a,y", 1.0, "a", "y"), ("n", None, 1.0, None, None), (None, "k", 5.0, "k", "k")])
    ties = spark.createDataFrame([("t", i % 2, i) for i in range(400)], "g string, o int, i int").repartition(7)
    kept = {n: rows_of(dedup.first_rows(ties, 150, ["g"], ["o"], hot_rows=n)) for n in (None, 0, 10**6)}
    assert kept[None] == kept[0] == kept[10**6] and sum(kept[0].values()) == 150


@pytest.mark.parametrize("n", [1, 4, 30, 200])
@pytest.mark.parametrize("limit", [0, 25, 10**6])
def test_first_rows_by_groups_of_tasks(spark, n, limit):
    """One step, two steps or slices give the same rows, for one hot key and many small ones, with ties and NULLs."""
    rows = [("hot" if i % 3 else f"k{i % 40}", None if i % 11 == 0 else i * 37 % 50, i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(11)
    want = rows_of(dedup.first_rows(df, n, ["g"], ["o"]))
    assert rows_of(dedup.first_rows(df, n, ["g"], ["o"], hot_rows=limit)) == want
    top = rows_of(filtering.limit_rows(df, n, ["o"]))
    assert rows_of(filtering.limit_rows(df, n, ["o"], hot_rows=limit)) == top and sum(top.values()) == n
    by_key = {}
    for g, o, _ in rows:
        by_key.setdefault(g, []).append((o is None, o or 0))
    assert Counter((g, o is None, o or 0) for g, o, _ in want.elements()) == Counter((g, *x) for g, v in by_key.items() for x in sorted(v)[:n])


def test_top_n_has_two_levels(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    ranks = lambda out: out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    small, large = (ranks(dedup.first_rows(df, 3, ["g"], ["id"], hot_rows=h)) for h in (10**6, 12))
    assert (small.count("Window ["), large.count("Window [")) == (1, 2) and large.count("Partial") == 2
    assert "hashpartitioning(_g0" in large and "_tasks" in large and "_tasks" not in small
    small, large = (ranks(filtering.limit_rows(df, 3, ["id"], hot_rows=h)) for h in (10**6, 12))
    assert "TakeOrderedAndProject" in small and "TakeOrderedAndProject" in large
    assert "_tasks" not in small and "hashpartitioning(_tasks" in large and "Partial" in large


def test_limit_rows_decides_ties(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, i) for i in range(300)], "o int, i int")
    small = rows_of(filtering.limit_rows(df.repartition(9), 150, ["o"]))
    assert small == rows_of(filtering.limit_rows(df.repartition(4), 150, ["o"]))
    monkeypatch.setattr(filtering, "TOP_ROWS", 10)
    assert small == rows_of(filtering.limit_rows(df, 150, ["o"]))


def test_scd_updates_with_repeated_keys(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(1, "x", 5), (1, "y", None), (3, "n", 1), (3, "m", 2)], "k int, v string, t int")
    assert rows_of(scd.scd1(dim, updates, ["k"], ["v"], order=["t"])) == Counter([(1, "y"), (2, "b"), (3, "m")])
    with pytest.raises(PySparkException):
        scd.scd1(dim, updates, ["k"], ["v"]).collect()
    once = updates.where("t = 5 OR t = 1")
    assert rows_of(scd.scd1(dim, once, ["k"], ["v"])) == Counter([(1, "x"), (2, "b"), (3, "n")])


def test_synthetic_numbers_stay_inside_their_types(spark):
    kinds = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DecimalType(5, 2), T.DecimalType(2, 2), T.DecimalType(3, 0), T.DecimalType(38, 10), T.DecimalType(1, 0)]
    for prefix in ("row_id", "amount"):
        schema = T.StructType([T.StructField(f"{prefix}{i}", k, False) for i, k in enumerate(kinds)])
        out = synth.synth_table(spark, schema, 70_000)
        for f in out.schema.fields:
            low, high = out.agg(F.min(f.name), F.max(f.name)).first()
            assert low is not None and low >= 0 and high > 0, f.name


def test_markers_of_date_routines(spark):
    for text, status in (("Date.addDate(x", "fail"), ("Date.diffDate(a, b)", "fail"), ("a context.name", "fail"), ("Date. Then", "pass"), ("plain", "pass")):
        df = spark.createDataFrame([(1, text), (2, "x")], "id int, v string")
        checks = {r["check"]: r for r in quality.validate(df, "m").collect()}
        assert checks["Code Markers"]["status"] == status and (checks["Code Markers"]["recommendation"] == "") == (status == "pass")


def test_null_analysis_names_all_columns(spark):
    df = spark.createDataFrame([(i,) for i in range(3)], "id int").select("id", *[F.lit(None).cast("string").alias(f"c{i}") for i in range(9)])
    row = {r["check"]: r for r in quality.validate(df, "m").collect()}["NULL Analysis"]
    assert row["status"] == "fail" and row["category"] == "translation" and row["detail"].endswith(", ".join(f"c{i}" for i in range(9)))
