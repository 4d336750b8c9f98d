"""Slowly changing dimensions and change application."""

from pyspark.sql import functions as F

from rowmill.operators import scd
from rowmill.plans.registry import query

# Customers below zero move to another segment; suppliers arrive as new customers behind the largest key.
_UPDATES = """updates AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'WATCH' ELSE c_mktsegment END AS c_mktsegment FROM customer
    WHERE c_acctbal < 1000 UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + 1 + s_suppkey, s_name, 'NEW' FROM supplier)"""


def _updates(t):
    old = t.customer.where("c_acctbal < 1000").select(
        "c_custkey", "c_name", F.when(F.col("c_acctbal") < 0, "WATCH").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    )
    top = t.customer.agg(F.max("c_custkey").alias("m")).scalar()
    new = t.supplier.select((top + 1 + F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return old.unionAll(new)


@query(
    "d01_scd1",
    f"""WITH {_UPDATES} SELECT coalesce(c.c_custkey, u.c_custkey) AS c_custkey, coalesce(c.c_name, u.c_name) AS c_name, c.c_acctbal AS c_acctbal,
        coalesce(u.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN updates u ON u.c_custkey = c.c_custkey""",
)
def d01(t):
    dim = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return scd.scd1(dim, _updates(t), ["c_custkey"], ["c_mktsegment"])


# Several updates of one key: the one with the largest price and key counts.
_REPEATED = """updates AS (SELECT c_custkey, c_name, c_mktsegment FROM (SELECT o_custkey AS c_custkey, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS c_name, o_orderpriority AS c_mktsegment,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)"""


def _repeated(t):
    return t.orders.selectExpr("o_custkey AS c_custkey", "concat('Customer#', lpad(cast(o_custkey AS string), 9, '0')) AS c_name", "o_orderpriority AS c_mktsegment", "o_totalprice", "o_orderkey")


@query(
    "d01_scd1_repeated",
    f"""WITH {_REPEATED} SELECT coalesce(c.c_custkey, u.c_custkey) AS c_custkey, coalesce(c.c_name, u.c_name) AS c_name, c.c_acctbal AS c_acctbal,
        coalesce(u.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN updates u ON u.c_custkey = c.c_custkey""",
)
def d01_repeated(t):
    dim = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return scd.scd1(dim, _repeated(t), ["c_custkey"], ["c_mktsegment"], order=["o_totalprice", "o_orderkey"])


# A dimension with history: every customer has a current version, rich ones an older closed one.
_DIM = """dim AS (SELECT c_custkey * 2 AS sk, c_custkey, c_name, c_mktsegment, DATE '2024-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to, true AS is_current FROM customer
    UNION ALL SELECT c_custkey * 2 + 1, c_custkey, c_name, 'OLD', DATE '2023-01-01', DATE '2024-01-01', false FROM customer WHERE c_acctbal > 5000)"""
_CHANGED = "u.c_custkey IS NOT NULL AND u.c_mktsegment IS DISTINCT FROM d.c_mktsegment"
_SCD2 = f"""closed AS (SELECT d.sk, d.c_custkey, d.c_name, d.c_mktsegment, d.valid_from,
      CASE WHEN d.is_current AND {_CHANGED} THEN DATE '2024-06-01' ELSE d.valid_to END AS valid_to, d.is_current AND NOT coalesce({_CHANGED}, false) AS is_current
      FROM dim d LEFT JOIN updates u ON u.c_custkey = d.c_custkey),
    fresh AS (SELECT u.c_custkey, u.c_name, u.c_mktsegment FROM updates u LEFT JOIN dim d ON d.c_custkey = u.c_custkey AND d.is_current
      WHERE d.c_custkey IS NULL OR u.c_mktsegment IS DISTINCT FROM d.c_mktsegment)"""


def _dim(t):
    current = t.customer.selectExpr(
        "c_custkey * 2 AS sk", "c_custkey", "c_name", "c_mktsegment", "DATE '2024-01-01' AS valid_from", "CAST(NULL AS DATE) AS valid_to", "true AS is_current"
    )
    old = t.customer.where("c_acctbal > 5000").selectExpr(
        "c_custkey * 2 + 1", "c_custkey", "c_name", "'OLD'", "DATE '2023-01-01'", "DATE '2024-01-01'", "false"
    )
    return current.unionAll(old)


@query(
    "d02_scd2",
    f"""WITH {_UPDATES}, {_DIM}, {_SCD2} SELECT c_custkey, c_name, c_mktsegment, valid_from, valid_to, is_current FROM closed
        UNION ALL SELECT c_custkey, c_name, c_mktsegment, DATE '2024-06-01', NULL, true FROM fresh""",
)
def d02(t):
    return scd.scd2(_dim(t).drop("sk"), _updates(t), ["c_custkey"], ["c_mktsegment"], F.lit("2024-06-01").cast("date"))


@query(
    "d02_scd2_repeated",
    f"""WITH {_REPEATED}, {_DIM}, {_SCD2} SELECT c_custkey, c_name, c_mktsegment, valid_from, valid_to, is_current FROM closed
        UNION ALL SELECT c_custkey, c_name, c_mktsegment, DATE '2024-06-01', NULL, true FROM fresh""",
)
def d02_repeated(t):
    as_of = F.lit("2024-06-01").cast("date")
    return scd.scd2(_dim(t).drop("sk"), _repeated(t), ["c_custkey"], ["c_mktsegment"], as_of, order=["o_totalprice", "o_orderkey"])


@query(
    "d03_surrogate_keys",
    f"""WITH {_UPDATES}, {_DIM}, {_SCD2} SELECT sk, c_custkey, c_name, c_mktsegment, valid_from, valid_to, is_current FROM closed
        UNION ALL SELECT (SELECT max(sk) FROM dim) + row_number() OVER (ORDER BY c_custkey), c_custkey, c_name, c_mktsegment, DATE '2024-06-01', NULL, true FROM fresh""",
)
def d03(t):
    return scd.scd2(_dim(t), _updates(t), ["c_custkey"], ["c_mktsegment"], F.lit("2024-06-01").cast("date"), surrogate="sk")


_FEED = """SELECT event_id, user_id AS c_custkey, ts, event_type AS c_mktsegment,
    CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'u' END AS op FROM events"""


def _feed(t):
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("u")
    return t.events.select("event_id", F.col("user_id").alias("c_custkey"), "ts", F.col("event_type").alias("c_mktsegment"), op.alias("op"))


@query(
    "s16_change_feed",
    f"SELECT event_id, c_custkey, CASE upper(op) WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' WHEN 'D' THEN 'delete' END AS change FROM ({_FEED})",
)
def s16(t):
    return scd.read_change_feed(_feed(t), "op").select("event_id", "c_custkey", "change")


@query(
    "d04_apply_changes",
    f"""WITH last AS (SELECT * FROM ({_FEED}) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY ts DESC, event_id DESC) = 1)
        SELECT coalesce(c.c_custkey, l.c_custkey) AS c_custkey, c.c_name AS c_name, coalesce(l.c_mktsegment, c.c_mktsegment) AS c_mktsegment
        FROM customer c FULL JOIN last l ON l.c_custkey = c.c_custkey WHERE coalesce(l.op, '') <> 'D'""",
)
def d04(t):
    base = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    changes = scd.read_change_feed(_feed(t), "op")
    return scd.apply_changes(base, changes, ["c_custkey"], ["ts", "event_id"])


_HISTORY = """WITH s AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       c AS (SELECT * FROM s WHERE before IS DISTINCT FROM event_type)
       SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS is_current FROM c
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query("d05_history_from_log", _HISTORY)
def d05(t):
    return scd.history_from_log(t.events, ["user_id"], "ts", ["event_type"], ["event_id"])


@query("d05_history_sliced", _HISTORY)
def d05_sliced(t):
    return scd.history_from_log(t.events, ["user_id"], "ts", ["event_type"], ["event_id"], hot_rows=0)
