"""Scalar functions: the traps, NULL and the empty text."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowmill.functions import dates as d
from rowmill.functions import logic as g
from rowmill.functions import numbers as n
from rowmill.functions import strings as s
from rowmill.functions import system
from rowmill.operators.mapping import with_context
from rowmill.plans import load

QUERIES, _ = load()


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("r")).first()["r"]


def pair(spark, a, b, column):
    return spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz").select(column.alias("r")).first()["r"]


T = datetime.datetime


def test_add_date_units_keep_case(spark):
    start = T(2024, 1, 31, 10, 5, 7)
    assert one(spark, start, "timestamp_ntz", d.add_date("x", 1, "MM")) == T(2024, 2, 29, 10, 5, 7)
    assert one(spark, start, "timestamp_ntz", d.add_date("x", 1, "mm")) == T(2024, 1, 31, 10, 6, 7)
    assert one(spark, start, "timestamp_ntz", d.add_date("x", 1, "dd")) == T(2024, 2, 1, 10, 5, 7)
    assert one(spark, start, "timestamp_ntz", d.add_date("x", 250, "SSS")) == T(2024, 1, 31, 10, 5, 7, 250000)
    assert one(spark, start, "timestamp_ntz", d.add_to_date("x", "YEAR", -1)) == T(2023, 1, 31, 10, 5, 7)
    assert one(spark, None, "timestamp_ntz", d.add_date("x", 1, "MM")) is None
    with pytest.raises(ValueError):
        d.add_date("x", 1, "parsec")


def test_diff_date_counts_borders_and_floor_counts_whole_units(spark):
    a, b = T(2024, 2, 1), T(2024, 1, 31)
    assert pair(spark, a, b, d.diff_date("a", "b", "MM")) == 1
    assert pair(spark, a, b, d.diff_date_floor("a", "b", "MM")) == 0
    assert pair(spark, b, a, d.diff_date("a", "b", "MM")) == -1
    assert pair(spark, T(2024, 1, 1, 1, 0, 0), T(2024, 1, 1, 0, 59, 59), d.diff_date("a", "b", "HH")) == 1
    assert pair(spark, T(2024, 1, 1, 1, 0, 0), T(2024, 1, 1, 0, 59, 59), d.diff_date_floor("a", "b", "HH")) == 0
    assert pair(spark, None, b, d.diff_date("a", "b", "dd")) is None


moments = st.datetimes(min_value=T(1990, 1, 1), max_value=T(2060, 1, 1))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(moments, moments), min_size=1, max_size=20))
def test_diff_date_matches_calendar_arithmetic(spark, rows):
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = df.select("a", "b", *[d.diff_date("a", "b", u).alias(u) for u in ("yyyy", "MM", "dd", "HH", "mm", "ss")]).collect()
    for r in got:
        a, b = r["a"], r["b"]
        assert r["yyyy"] == a.year - b.year
        assert r["MM"] == (a.year - b.year) * 12 + a.month - b.month
        assert r["dd"] == (a.date() - b.date()).days
        for unit, size in (("HH", 3600), ("mm", 60), ("ss", 1)):
            steps = [int((t - T(1970, 1, 1)).total_seconds() // size) for t in (a.replace(microsecond=0), b.replace(microsecond=0))]
            assert r[unit] == steps[0] - steps[1]


def test_compare_date_null_is_one(spark):
    assert pair(spark, None, T(2024, 1, 1), d.compare_date("a", "b")) == 1
    assert pair(spark, T(2024, 1, 1, 5), T(2024, 1, 1, 7), d.compare_date("a", "b", "yyyy-MM-dd")) == 0
    assert pair(spark, T(2024, 1, 1, 5), T(2024, 1, 1, 7), d.compare_date("a", "b")) == -1


def test_part_of_date(spark):
    when = T(2024, 12, 29, 23, 59, 58)
    for part, want in {"MONTH": 11, "YEAR": 2024, "DAY_OF_MONTH": 29, "DAY_OF_YEAR": 364, "DOW": 0, "DAY_OF_WEEK": 1, "SECOND": 58}.items():
        assert one(spark, when, "timestamp_ntz", d.part_of_date(part, "x")) == want


def test_parse_and_check_dates(spark):
    assert one(spark, "29.02.2024", "string", d.parse_date("dd.MM.yyyy", "x")) == T(2024, 2, 29)
    assert one(spark, "30.02.2024", "string", d.is_date("x", "dd.MM.yyyy")) is False
    assert one(spark, None, "string", d.is_date("x", "dd.MM.yyyy")) is False
    assert one(spark, "bad", "string", d.try_parse_date("dd.MM.yyyy", "x")) is None
    with pytest.raises(PySparkException):
        one(spark, "bad", "string", d.parse_date("dd.MM.yyyy", "x"))


def test_percent_patterns():
    assert d.java_pattern("%Y-%m-%d") == "yyyy-MM-dd"
    assert d.java_pattern("%d at %H:%i") == "dd' at 'HH:mm"


def test_strings_count_from_zero(spark):
    assert one(spark, "abcdef", "string", s.substr("x", 1, 3)) == "bcd"
    assert one(spark, "abcdef", "string", s.substring("x", 1, 3)) == "bc"
    assert one(spark, "abcdef", "string", s.substring("x", 4)) == "ef"
    assert one(spark, "abcdef", "string", s.index("x", "c")) == 2
    assert one(spark, "abcdef", "string", s.index("x", "z")) == -1


def test_matches_whole_and_search_part(spark):
    assert one(spark, "abc1", "string", s.matches("x", "[a-z]+")) is False
    assert one(spark, "abc1", "string", s.search("x", "[a-z]+")) is True
    assert one(spark, "a|b", "string", s.matches("x", "a|b")) is False
    assert one(spark, "abc\n", "string", s.is_alpha("x")) is False
    assert one(spark, "", "string", s.is_alpha("x")) is False


def test_string_edge_cases(spark):
    assert one(spark, "aXbXc", "string", s.count_of("x", "X")) == 2
    assert one(spark, "aXbXc", "string", s.count_of("x", "")) is None
    assert one(spark, "a.b", "string", s.change("x", ".", "$1")) == "a$1b"
    assert one(spark, "ab", "string", s.ereplace("x", "(a)(b)", "$2$1")) == "ba"
    assert one(spark, "a,b", "string", s.quote_sql_list("x")) == "'a','b'"
    assert one(spark, None, "string", s.is_empty("x")) is True
    assert one(spark, None, "string", s.is_not_empty("x")) is False
    assert one(spark, None, "string", s.concat("a", F.col("x"))) is None
    assert one(spark, None, "string", s.upcase("x")) is None


@pytest.mark.parametrize("value,rounded,cut", [(1.7, 2, 1), (2.5, 2, 2), (-1.5, -2, -1), (3.5, 4, 3), (None, None, None)])
def test_integer_modes(spark, value, rounded, cut):
    assert one(spark, value, "double", n.integer("x")) == rounded
    assert one(spark, value, "double", n.fix("x")) == rounded
    assert one(spark, value, "double", n.integer("x", "truncate")) == cut


def test_small_that_does_not_fit(spark, tmp_path):
    assert one(spark, 32767, "bigint", n.small("x")) == one(spark, 32767, "bigint", n.small("x", strict=False)) == 32767
    assert one(spark, 32768, "bigint", n.small("x", strict=False)) is None
    with pytest.raises(PySparkException, match="CAST_OVERFLOW"):
        one(spark, 32768, "bigint", n.small("x"))
    rows = [(1, 7, "view", 1.0), (2, 40_000, "click", 2.5), (3, None, "click", None)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["f109_f114_conversions"](spark, str(tmp_path)).select("event_id", "i", "sm").collect()
    assert {tuple(r) for r in got} == {(1, 7, 7), (2, 40_000, None), (3, None, None)}


def test_conversions_stop_at_a_number_that_does_not_fit(spark, tmp_path):
    rows = [(1, 7, "view", 1.0), (2, 32_767, "click", 2.5), (3, None, "click", None)]
    for name, more in (("fits", []), ("over", [(4, 32_768, "click", 2.5)])):
        table = spark.createDataFrame(rows + more, "event_id bigint, user_id bigint, event_type string, value double")
        table.write.parquet(f"{tmp_path}/{name}/events.parquet")
    got = QUERIES["f109_f114_conversions"](spark, f"{tmp_path}/fits").select("event_id", "i", "sm").collect()
    assert {tuple(r) for r in got} == {(1, 7, 7), (2, 32_767, 32_767), (3, None, None)}
    with pytest.raises(PySparkException, match="CAST_OVERFLOW"):
        QUERIES["f109_f114_conversions"](spark, f"{tmp_path}/over").collect()


def test_numbers(spark):
    assert one(spark, -7, "int", n.modulo("x", 3)) == -1
    assert one(spark, 2.5, "double", n.rounded("x")) == 3.0
    assert one(spark, -2.5, "double", n.rounded("x")) == -3.0
    assert one(spark, 255, "bigint", n.to_hex("x")) == "ff"
    assert one(spark, "ff", "string", n.from_hex("x")) == 255
    assert one(spark, "xyz", "string", n.from_hex("x")) is None
    assert one(spark, "7FFFFFFFFFFFFFFF", "string", n.from_hex("x")) == 2**63 - 1
    assert one(spark, "0000000000000000000001", "string", n.from_hex("x")) == 1
    assert one(spark, "8000000000000000", "string", n.from_hex("x")) is None
    assert one(spark, "0", "string", n.from_hex("x")) == 0
    assert one(spark, 8364, "int", n.char("x")) == "€"
    assert one(spark, None, "double", n.greatest("x", 3.0)) == 3.0
    assert one(spark, "x1", "string", n.parse_int("x", strict=False)) is None
    with pytest.raises(PySparkException):
        one(spark, "x1", "string", n.parse_int("x"))


def test_random_stays_in_range(spark):
    rows = spark.range(2000).select(n.random_int(3, 5, seed=1).alias("r")).distinct().collect()
    assert sorted(r["r"] for r in rows) == [3, 4, 5]


def test_choose_and_defaults(spark):
    assert one(spark, None, "int", g.choose(F.col("x") > 1, "a", g.choose(F.col("x").isNull(), "none", "b"))) == "none"
    assert one(spark, None, "int", g.nvl("x", 7)) == 7


def test_run_and_context(spark):
    run = system.Run(job_name="j")
    row = spark.range(1).select(run.variable("pid").alias("a"), run.variable("rootPid").alias("b"), run.variable("jobName").alias("c")).first()
    assert row["a"] == row["b"] == run.run_id and row["c"] == "j"
    df = with_context(spark.createDataFrame([(1,), (5,)], "x int"), {"floor": 3})
    assert [r["x"] for r in df.where("x > context.floor").select("x").collect()] == [5]


def test_diff_date_in_all_units(spark):
    a, b = T(2024, 3, 4, 0, 0, 0), T(2023, 12, 31, 23, 59, 59, 999600)
    assert pair(spark, a, b, d.diff_date("a", "b", "SSS")) == 64 * 86_400_000 - 86_400_000 + 1
    assert pair(spark, a, b, d.diff_date("a", "b", "quarter")) == 1
    assert pair(spark, a, b, d.diff_date("a", "b", "week")) == 10
