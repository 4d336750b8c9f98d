"""Synthetic rows: one per order, so the work grows with the table."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.operators import synth
from rowmill.plans.registry import query
from rowmill.session import scratch_path
from rowmill.sinks.files import write_delimited
from rowmill.sources.files import read_delimited
from rowmill.sources.tables import generate_rows_per


def _draw(column, salt=""):
    return f"('0x' || substr(md5('42|{column}{salt}|' || o_orderkey), 1, 8))::BIGINT"


def _nullable(column, value):
    return f'CASE WHEN {_draw(column, "?")} % 100 >= 5 THEN {value} END AS "{column}"'


def _pick(column, values):
    return f"[{', '.join(repr(v) for v in values)}][{_draw(column)} % {len(values)} + 1]"


_TYPED = T.StructType(
    [
        T.StructField("size_int", T.IntegerType(), False),
        T.StructField("amount", T.DoubleType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("day", T.DateType()),
        T.StructField("moment", T.TimestampNTZType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload", T.StringType()),
    ]
)


@query(
    "g01_g04_typed_columns",
    f"""SELECT o_orderkey, CAST({_draw("size_int")} % 10000 + 1 AS INTEGER) AS size_int, {_nullable("amount", f'({_draw("amount")} % 9999999 + 1) / 100.0::DOUBLE')},
        {_nullable("active", f'{_draw("active")} % 2 = 0')}, {_nullable("day", f"DATE '2020-01-01' + CAST({_draw('day')} % 1501 AS INTEGER)")},
        {_nullable("moment", f"TIMESTAMP '2020-01-01' + to_days(CAST({_draw('moment')} % 1501 AS INTEGER)) + to_hours({_draw('moment')} // 1501 % 24)")},
        CAST(NULL AS BLOB) AS payload FROM orders""",
)
def typed(t):
    return synth.synth(t.orders, _TYPED, F.col("o_orderkey"), keep=["o_orderkey"])


_KEYS = T.StructType(
    [
        T.StructField("order_id", T.LongType(), False),
        T.StructField("ref_code", T.StringType(), False),
        T.StructField("key_day", T.DateType(), False),
        T.StructField("owner", T.IntegerType(), False, {"key": True}),
    ]
)


@query(
    "g02_join_keys",
    """SELECT c_custkey, c_custkey + 1 AS order_id, CAST(c_custkey + 1 AS VARCHAR) AS ref_code, DATE '2020-01-01' + CAST(c_custkey AS INTEGER) AS key_day,
       CAST(c_custkey + 1 AS INTEGER) AS owner FROM customer""",
)
def join_keys(t):
    return synth.synth(t.customer, _KEYS, F.col("c_custkey"), keep=["c_custkey"])


_NAMED = ["first_name", "job_title", "gender", "status", "dept", "priority", "uom", "qty", "email", "other"]


def _number(column, low, high):
    return f"CAST({_draw(column)} % {high - low + 1} + {low} AS VARCHAR)"


def _cents(column, low, high):
    return f"printf('%.2f', ({_draw(column)} % {high - low + 1} + {low}) / 100.0)"


# One column for each name rule, and names that fit several: the first rule in order wins.
_RULES = {
    "first_name": _pick("first_name", synth.FIRST_NAMES), "last_name": _pick("last_name", synth.LAST_NAMES), "middlename": "CAST(o_orderkey + 1 AS VARCHAR)",  # holds the key part "id", and key names come before all rules
    "fullname": f"{_pick('fullname', synth.FIRST_NAMES)} || ' ' || [{', '.join(repr(v) for v in synth.LAST_NAMES)}][({_draw('fullname')} // 8) % {len(synth.LAST_NAMES)} + 1]",
    "title": _pick("title", synth.TITLES), "suffix": _pick("suffix", synth.SUFFIXES), "sex": _pick("sex", synth.GENDERS), "email": "'user' || (o_orderkey + 1) || '@example.com'",
    "mobile": f"'555-' || {_number('mobile', 1000, 9999)}", "address": f"{_number('address', 1, 999)} || ' ' || {_pick('address', synth.STREETS)}", "city": _pick("city", synth.CITIES),
    "province": _pick("province", synth.STATES), "zip": _number("zip", 10000, 99999), "country": _pick("country", synth.COUNTRIES), "vendor": _pick("vendor", synth.COMPANIES),
    "dept": _pick("dept", synth.DEPARTMENTS), "position": _pick("position", synth.JOBS), "price": _cents("price", 100, 5_000_000), "rate": _cents("rate", 1, 10_000),
    "qty": _number("qty", 1, 500), "weight": _cents("weight", 10, 100_000), "hours": _cents("hours", 50, 4_000), "status": _pick("status", synth.STATUSES),
    "category": _pick("category", synth.TYPES), "flag": _pick("flag", synth.FLAGS), "priority": _pick("priority", synth.PRIORITIES),
    "remark": "'Description for item ' || (o_orderkey + 1)", "reason": _pick("reason", synth.REASONS), "website": "'https://example.com/' || (o_orderkey + 1)",
    "shipdate": f"strftime(DATE '2020-01-01' + CAST({_draw('shipdate')} % 1501 AS INTEGER), '%Y-%m-%d')",
    "time": f"printf('%02d:%02d:%02d', {_draw('time')} % 24, {_draw('time')} // 24 % 60, {_draw('time')} // 1440 % 60)", "uom": _pick("uom", synth.UNITS_OF_MEASURE),
    "colour": _pick("colour", synth.COLORS), "size": _pick("size", synth.SIZES), "tool": _pick("tool", synth.TOOLS),
    "version": f"{_number('version', 1, 10)} || '.' || ({_draw('version')} // 10 % 10)", "login": f"'user' || {_number('login', 1, 999)}",
    "jobtitle": _pick("jobtitle", synth.JOBS), "state_status": _pick("state_status", synth.STATES), "city_state": _pick("city_state", synth.CITIES), "dept_position": _pick("dept_position", synth.DEPARTMENTS),
}


@query("g03_name_rules", f"SELECT o_orderkey, {', '.join(f'{sql} AS {name}' for name, sql in _RULES.items())} FROM orders")
def name_rules(t):
    schema = T.StructType([T.StructField(n, T.StringType(), False) for n in _RULES])
    return synth.synth(t.orders, schema, F.col("o_orderkey"), keep=["o_orderkey"])


@query(
    "g02_small_keys",
    """SELECT o_orderkey, CAST(o_orderkey % 127 + 1 AS TINYINT) AS byte_id, CAST(o_orderkey % 32767 + 1 AS SMALLINT) AS short_id, CAST(o_orderkey % 999 + 1 AS DECIMAL(5, 2)) AS decimal_id FROM orders""",
)
def small_keys(t):
    schema = T.StructType([T.StructField("byte_id", T.ByteType(), False), T.StructField("short_id", T.ShortType(), False), T.StructField("decimal_id", T.DecimalType(5, 2), False)])
    return synth.synth(t.orders, schema, F.col("o_orderkey"), keep=["o_orderkey"])


@query(
    "g03_named_columns",
    f"""SELECT o_orderkey, {_pick("first_name", synth.FIRST_NAMES)} AS first_name, {_pick("job_title", synth.JOBS)} AS job_title, {_pick("gender", synth.GENDERS)} AS gender,
        {_pick("status", synth.STATUSES)} AS status, {_pick("dept", synth.DEPARTMENTS)} AS dept, {_pick("priority", synth.PRIORITIES)} AS priority,
        {_pick("uom", synth.UNITS_OF_MEASURE)} AS uom, CAST({_draw("qty")} % 500 + 1 AS VARCHAR) AS qty, 'user' || (o_orderkey + 1) || '@example.com' AS email,
        {_pick("other", synth.WORDS)} || '_' || (o_orderkey + 1) AS other FROM orders""",
)
def named(t):
    schema = T.StructType([T.StructField(n, T.StringType(), False) for n in _NAMED])
    return synth.synth(t.orders, schema, F.col("o_orderkey"), keep=["o_orderkey"])


_PATCH = """SELECT s_suppkey, CAST(v AS BIGINT) AS s_ref FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier) s
    JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS size FROM (SELECT DISTINCT o_orderkey AS v FROM orders WHERE o_orderstatus = 'P' {0})) p ON n % size = i"""


def _children(t):
    return t.supplier.select("s_suppkey", (-F.col("s_suppkey") - 1).alias("s_ref"))


@query("g05_patch_foreign_key", _PATCH.format(""))
def patch(t):
    parent = t.orders.where("o_orderstatus = 'P'")
    return synth.patch_foreign_key(parent, "o_orderkey", _children(t), "s_ref", ["s_suppkey"])


# Every line takes one of all customers in turn.
@query(
    "g05_patch_all_values",
    """SELECT o_orderkey, CAST(v AS BIGINT) AS o_ref FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) o
       JOIN (SELECT c_custkey AS v, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS size FROM customer) p ON n % size = i""",
)
def patch_all(t):
    child = t.orders.select("o_orderkey", (-F.col("o_custkey") - 1).alias("o_ref"))
    return synth.patch_foreign_key(t.customer, "c_custkey", child, "o_ref", ["o_orderkey"])


@query("g05_patch_not_needed", "SELECT o_orderkey, o_custkey FROM orders")
def patch_kept(t):
    return synth.patch_foreign_key(t.customer, "c_custkey", t.orders.select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"])


@query(
    "g06_g07_reconcile",
    "SELECT n_nationkey, n_name, n_regionkey, CAST(NULL AS VARCHAR) AS iso_code, CAST(NULL AS VARCHAR) AS c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey",
)
def reconcile(t):
    rows = t.customer.select("c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey")
    return synth.reconcile(rows, ["N_NAME", "iso_code", "ISO_CODE", "c_custkey"])


@query(
    "g08_csv_export",
    f"""SELECT o_orderkey, CAST({_draw("size_int")} % 10000 + 1 AS INTEGER) AS size_int, {_pick("status", synth.STATUSES)} AS status FROM orders""",
)
def csv_export(t):
    schema = T.StructType([T.StructField("size_int", T.IntegerType(), False), T.StructField("status", T.StringType(), False)])
    path = scratch_path(t.spark, "csv")
    write_delimited(synth.synth(t.orders, schema, F.col("o_orderkey"), keep=["o_orderkey"]), path)
    return read_delimited(t.spark, path, "o_orderkey bigint, size_int int, status string")


@query(
    "s13_generate_rows",
    """SELECT o_orderkey, id + 1 AS number, 'line-' || id AS label, o_totalprice / n AS share FROM (
       SELECT o_orderkey, o_totalprice, n, unnest(range(n)) AS id FROM (SELECT *, o_orderkey % 4 + 1 AS n FROM orders))""",
)
def s13(t):
    return generate_rows_per(
        t.orders.withColumn("n", F.col("o_orderkey") % 4 + 1), "n", {"number": "id + 1", "label": "concat('line-', id)", "share": "o_totalprice / n"}
    ).select("o_orderkey", "number", "label", "share")
