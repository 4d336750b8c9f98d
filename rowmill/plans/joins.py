"""Lookups."""

from pyspark.sql import functions as F

from rowmill.operators import aggregate as agg
from rowmill.operators import filtering, joins, mapping
from rowmill.plans.registry import query


@query(
    "flagship_order_value",
    """
    SELECT n.n_name AS nation, upper(o.o_orderpriority) AS priority, CAST(year(o.o_orderdate) AS INTEGER) AS order_year,
           count(o.o_orderkey) AS orders, round(sum(o.o_totalprice), 2) AS total_value, max(o.o_totalprice) AS largest
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    WHERE c.c_acctbal > 0 AND o.o_orderstatus <> 'P' AND o.o_totalprice / 1000 >= 10
    GROUP BY ALL
    """,
)
def flagship(t):
    """Orders with customer and nation looked up, mapped with a variable, filtered, aggregated and sorted."""
    row = joins.lookup(t.orders.alias("row1"), t.customer, {"c_custkey": "row1.o_custkey"}, "inner", name="row2")
    row = joins.lookup(row, t.nation, {"n_nationkey": "row2.c_nationkey"}, "left", name="row3")
    mapped = mapping.map_columns(
        row,
        {
            "nation": "row3.n_name",
            "priority": F.upper("row1.o_orderpriority"),
            "order_year": F.year("row1.o_orderdate"),
            "order_key": "row1.o_orderkey",
            "status": "row1.o_orderstatus",
            "value": "row1.o_totalprice",
            "thousands": "Var.thousands",
        },
        variables={"thousands": "row1.o_totalprice / 1000"},
        where="row2.c_acctbal > 0",
    )
    kept = filtering.filter_rows(mapped, [("status", "!=", "P"), ("thousands", ">=", 10.0)])
    total = agg.aggregate(
        kept, ["nation", "priority", "order_year"],
        [("order_key", "count", "orders"), ("value", "sum", "total_value"), ("value", "max", "largest")],
    )
    out = total.withColumn("total_value", F.round("total_value", 2))
    return filtering.sort_rows(out, ["nation", "priority", "order_year"])


@query(
    "j01_inner_lookup",
    "SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey",
)
def j01(t):
    out = joins.lookup(t.orders.alias("row1"), t.customer, {"c_custkey": "row1.o_custkey"}, name="row2")
    return out.select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query(
    "j02_left_lookup",
    """SELECT o.o_orderkey, c.c_name FROM orders o
       LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey""",
)
def j02(t):
    ref = t.customer.where("c_acctbal > 0")
    return joins.lookup(t.orders.alias("row1"), ref, {"c_custkey": "row1.o_custkey"}, "left").select("o_orderkey", "c_name")


@query("j03_keyless_lookup", "SELECT c.c_custkey, r.r_name FROM customer c CROSS JOIN region r")
def j03(t):
    # Region has five rows: they are constants of the plan, and no join is made.
    return joins.lookup(t.customer, t.region, {}).select("c_custkey", "r_name")


@query(
    "j04_right_lookup",
    """SELECT o.o_orderkey, c.c_custkey, c.c_name FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') o
       RIGHT JOIN customer c ON c.c_custkey = o.o_custkey""",
)
def j04(t):
    main = t.orders.where("o_orderstatus = 'P'").alias("row1")
    return joins.lookup(main, t.customer, {"c_custkey": "row1.o_custkey"}, "right").select("o_orderkey", "c_custkey", "c_name")


@query(
    "j05_full_lookup",
    """SELECT o.o_orderkey, c.c_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') o
       FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey""",
)
def j05(t):
    main = t.orders.where("o_orderstatus = 'P'").alias("row1")
    ref = t.customer.where("c_acctbal > 0")
    return joins.lookup(main, ref, {"c_custkey": "row1.o_custkey"}, "full").select("o_orderkey", "c_custkey")


@query(
    "j06_expression_key",
    """SELECT s.s_suppkey, c.c_custkey FROM supplier s
       JOIN customer c ON upper(c.c_name) = 'CUSTOMER#' || lpad(CAST(s.s_suppkey AS VARCHAR), 9, '0')""",
)
def j06(t):
    ref = t.customer.withColumn("c_upper", F.upper("c_name"))
    key = "concat('CUSTOMER#', lpad(cast(row1.s_suppkey AS string), 9, '0'))"
    return joins.lookup(t.supplier.alias("row1"), ref, {"c_upper": key}).select("s_suppkey", "c_custkey")


@query(
    "j07_chained_lookups",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_custkey, c.c_name, n.n_name, r.r_name
       FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
       LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
)
def j07(t):
    row = joins.lookup(t.lineitem.alias("row1"), t.orders, {"o_orderkey": "row1.l_orderkey"}, name="row2")
    row = joins.lookup(row, t.customer, {"c_custkey": "row2.o_custkey"}, name="row3")
    row = joins.lookup(row, t.nation, {"n_nationkey": "row3.c_nationkey"}, "left", name="row4")
    row = joins.lookup(row, t.region, {"r_regionkey": "row4.n_regionkey"}, "left", name="row5")
    return row.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "c_name", "n_name", "r_name")


_MATCH = """SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {0}, o_orderkey {0}) AS rn
      FROM orders) WHERE rn = 1) o ON o.o_custkey = c.c_custkey"""


@query("j08_first_match", _MATCH.format("ASC"))
def j08_first(t):
    out = joins.lookup(
        t.customer.alias("row1"), t.orders, {"o_custkey": "row1.c_custkey"}, "left", "first", ["o_orderdate", "o_orderkey"], tie=[]
    )
    return out.select("c_custkey", "o_orderkey", "o_totalprice")


@query("j08_unique_match", _MATCH.format("DESC"))
def j08_unique(t):
    out = joins.lookup(
        t.customer.alias("row1"), t.orders, {"o_custkey": "row1.c_custkey"}, "left", "unique", ["o_orderdate", "o_orderkey"], tie=[]
    )
    return out.select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "j09_lookup_reject",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o_custkey AND c.c_acctbal > 0)""",
)
def j09(t):
    ref = t.customer.where("c_acctbal > 0")
    return joins.lookup_reject(t.orders.alias("row1"), ref, {"c_custkey": "row1.o_custkey"}).select("o_orderkey", "o_custkey")


@query(
    "j10_fuzzy_lookup",
    """WITH typed AS (SELECT p_partkey, substr(p_name, 1, 1) || substr(p_name, 3) AS entered FROM part),
       m AS (SELECT DISTINCT entered FROM typed), r AS (SELECT DISTINCT p_name FROM part),
       near AS (SELECT entered, p_name, levenshtein(entered, p_name) AS distance FROM m, r WHERE levenshtein(entered, p_name) <= 2)
       SELECT t.p_partkey, t.entered, n.p_name, CAST(n.distance AS INTEGER) AS distance FROM typed t JOIN near n USING (entered)""",
)
def j10(t):
    typed = t.part.select("p_partkey", F.expr("concat(substr(p_name, 1, 1), substr(p_name, 3))").alias("entered"))
    return joins.fuzzy_lookup(typed, t.part.select("p_name").distinct(), "entered", "p_name", 2)


@query(
    "j11_simple_join",
    """SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, p.p_brand AS brand, p.p_retailprice AS list_price
       FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON p.p_partkey = l.l_partkey""",
)
def j11(t):
    main = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    ref = t.part.where("p_size > 10")
    return joins.simple_join(main, ref, {"p_partkey": "l_partkey"}, {"p_brand": "brand", "p_retailprice": "list_price"})


@query(
    "p23_locate_ip",
    """WITH visits AS (SELECT event_id, (user_id * 7919 + 167772160) AS ip FROM events),
       bounds AS (SELECT s_suppkey, 167772160 + s_suppkey * 3000 AS lo, 167772160 + s_suppkey * 3000 + 1999 AS hi FROM supplier)
       SELECT v.event_id, b.s_suppkey FROM visits v LEFT JOIN bounds b ON v.ip BETWEEN b.lo AND b.hi""",
)
def p23(t):
    number = F.col("user_id") * 7919 + 167772160  # 10.0.0.0
    dotted = F.concat_ws(".", *[F.floor(number / 256**i) % 256 for i in (3, 2, 1, 0)])
    visits = t.events.select("event_id", dotted.alias("address"))
    low = F.lit(167772160) + F.col("s_suppkey") * 3000
    bounds = t.supplier.select("s_suppkey", low.alias("lo"), (low + 1999).alias("hi"))
    out = joins.locate_ip(visits, "address", bounds, "lo", "hi", ["s_suppkey"])
    return out.select("event_id", "s_suppkey")


@query(
    "p25_iterate_params",
    """WITH params AS (SELECT o_orderpriority AS priority, avg(o_totalprice) AS floor_price FROM orders GROUP BY 1)
       SELECT p.priority AS priority, count(*) AS orders FROM orders o JOIN params p
       ON o.o_totalprice > round(p.floor_price, 0) AND o.o_orderpriority >= p.priority GROUP BY p.priority""",
)
def p25(t):
    params = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.avg("o_totalprice"), 0).alias("floor_price"))
    rows = joins.iterate_params(
        t.orders.select("o_totalprice", "o_orderpriority"), params,
        "o_totalprice > param.floor_price AND o_orderpriority >= param.priority", "param",
    )
    return rows.groupBy("priority").agg(F.count("*").alias("orders"))
