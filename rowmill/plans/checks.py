"""Data checks and comparisons."""

from pyspark.sql import functions as F

from rowmill.operators import quality
from rowmill.plans.registry import query

# events with an audit column and a remark that are never filled, and code left in one column
_ODD = """odd AS (SELECT user_id, 'context.' || event_type AS label, CAST(NULL AS VARCHAR) AS etl_batch, CAST(NULL AS VARCHAR) AS remark, value FROM events)"""
_NONE = "none AS (SELECT c_custkey, c_name FROM customer WHERE c_name = 'nobody')"


def _odd(t):
    return t.events.select(
        "user_id", F.concat(F.lit("context."), "event_type").alias("label"), F.lit(None).cast("string").alias("etl_batch"),
        F.lit(None).cast("string").alias("remark"), "value",
    )


def _validation(t):
    none = t.customer.where("c_name = 'nobody'").select("c_custkey", "c_name")
    return (
        quality.validate(t.orders, "orders")
        .unionAll(quality.validate(_odd(t), "odd"))
        .unionAll(quality.validate(none, "none", inner_joins=1, joins=1))
    )


_CHECKS = f"""WITH {_ODD}, {_NONE}, o AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d FROM orders), e AS (SELECT count(*) AS n, count(DISTINCT user_id) AS d FROM odd),
  z AS (SELECT count(*) AS n FROM none), checks(model, "check", status, detail, category) AS (
  SELECT 'orders', 'Row Count', CASE WHEN n = 0 THEN 'fail' WHEN n < 2 THEN 'warn' ELSE 'pass' END, n || ' rows', 'data_quality' FROM o
  UNION ALL SELECT 'orders', 'Schema', 'pass', '6 columns', 'data_quality'
  UNION ALL SELECT 'orders', 'NULL Analysis', 'pass', 'No all-NULL columns', 'data_quality'
  UNION ALL SELECT 'orders', 'Key Uniqueness', 'pass', 'o_orderkey: ' || d || '/' || n || ' unique', 'data_quality' FROM o
  UNION ALL SELECT 'orders', 'Code Markers', 'pass', 'No code left in the data', 'translation'
  UNION ALL SELECT 'odd', 'Row Count', 'pass', n || ' rows', 'data_quality' FROM e
  UNION ALL SELECT 'odd', 'Schema', 'pass', '5 columns', 'data_quality'
  UNION ALL SELECT 'odd', 'NULL Analysis', 'warn', '1 unexpected all-NULL: remark', 'data_quality'
  UNION ALL SELECT 'odd', 'Key Uniqueness', CASE WHEN (1 - d / n) * 100 > 80 THEN 'warn' ELSE 'pass' END, 'user_id: ' || d || '/' || n || ' unique', 'data_quality' FROM e
  UNION ALL SELECT 'odd', 'Code Markers', 'fail', 'code left in: label', 'translation'
  UNION ALL SELECT 'none', 'Row Count', 'fail', '0 rows with 1 inner joins: join keys do not match', 'logic' FROM z WHERE n = 0
  UNION ALL SELECT 'none', 'Schema', 'pass', '2 columns', 'data_quality')"""


@query(
    "q01_q06_validate",
    f"""{_CHECKS} SELECT model, "check", status, detail, category, CASE WHEN model = 'none' AND status = 'fail' THEN 'Trace the filters and joins back to the first one that drops all rows.'
        WHEN "check" = 'NULL Analysis' AND status = 'warn' THEN 'Some columns are empty: check their sources.'
        WHEN "check" = 'Key Uniqueness' AND status = 'warn' THEN 'Many duplicates from one source: a grouping may be missing.'
        WHEN "check" = 'Code Markers' AND status = 'fail' THEN 'These expressions were not translated: complete them.' ELSE '' END AS recommendation FROM checks""",
)
def validation(t):
    return _validation(t)


_OVERALL = """overall AS (SELECT model, count(*) FILTER (status = 'pass') AS checks_pass, count(*) FILTER (status = 'warn') AS checks_warn,
   count(*) FILTER (status = 'fail') AS checks_fail FROM checks GROUP BY model),
   rated AS (SELECT *, CASE WHEN checks_fail > 0 THEN 'fail' WHEN checks_warn > 0 THEN 'warn' ELSE 'pass' END AS status FROM overall)"""


@query("q07_overall", f"{_CHECKS}, {_OVERALL} SELECT * FROM rated")
def overall(t):
    return quality.overall(_validation(t))


@query(
    "q07_summary",
    f"""{_CHECKS}, {_OVERALL}, s AS (SELECT count(*) AS total_models, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warn') AS warned,
        count(*) FILTER (status = 'fail') AS failed FROM rated)
        SELECT *, round_even(passed / total_models * 100, 0)::BIGINT || '%' AS pass_rate, round_even((passed + warned) / total_models * 100, 0)::BIGINT || '%' AS health_rate FROM s""",
)
def summary(t):
    return quality.summary(quality.overall(_validation(t)))


@query(
    "q02_lookup_match",
    """WITH o AS (SELECT count(*) FILTER (c.c_custkey IS NOT NULL) AS m, count(*) FILTER (c.c_custkey IS NULL) AS u FROM orders LEFT JOIN
         (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o_custkey),
       l AS (SELECT count(*) FILTER (p.c_name IS NOT NULL) AS m, count(*) FILTER (p.c_name IS NULL) AS u FROM orders LEFT JOIN customer p ON p.c_name = o_orderpriority)
       SELECT 'orders' AS model, 'lookup rich customer' AS "check", CASE WHEN m = 0 THEN 'fail' WHEN u > 0 THEN 'warn' ELSE 'pass' END AS status,
         m || ' matched, ' || u || ' unmatched' AS detail, 'logic' AS category, '' AS recommendation FROM o UNION ALL
       SELECT 'orders', 'lookup name', CASE WHEN m = 0 THEN 'fail' WHEN u > 0 THEN 'warn' ELSE 'pass' END, m || ' matched, ' || u || ' unmatched', 'logic', '' FROM l""",
)
def lookup_match(t):
    return quality.lookup_match(
        t.orders, "orders",
        [
            ("rich customer", t.customer.where("c_acctbal > 0"), {"c_custkey": "o_custkey"}),
            ("name", t.customer, {"c_name": "o_orderpriority"}),
        ],
    )


@query(
    "q03_column_schema",
    """SELECT 'lineitem' AS model, "check", 'pass' AS status, detail, 'data_quality' AS category FROM (
       SELECT 'Row Count' AS "check", count(*) || ' rows' AS detail FROM lineitem
       UNION ALL SELECT 'Schema', count(*) || ' columns' FROM (DESCRIBE lineitem))""",
)
def column_schema(t):
    checks = quality.validate(t.lineitem, "lineitem").where(F.col("check").isin("Row Count", "Schema"))
    return checks.drop("recommendation")


@query(
    "q08_q09_column_tests",
    """WITH e AS (SELECT *, nullif(event_type, 'view') AS kind FROM events),
       k AS (SELECT count(*) AS n FROM (SELECT user_id FROM e GROUP BY user_id HAVING count(*) > 1)),
       i AS (SELECT count(*) AS n FROM (SELECT event_id FROM e GROUP BY event_id HAVING count(*) > 1)),
       c(name, n) AS (SELECT 'not_null kind', count(*) FROM e WHERE kind IS NULL UNION ALL SELECT 'not_null event_id', count(*) FROM e WHERE event_id IS NULL
         UNION ALL SELECT 'not_null user_id', count(*) FROM e WHERE user_id IS NULL UNION ALL SELECT 'unique event_id', n FROM i UNION ALL SELECT 'unique user_id', n FROM k)
       SELECT 'events' AS model, name AS "check", CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, n || ' failing' AS detail, 'data_quality' AS category, '' AS recommendation FROM c""",
)
def column_tests(t):
    rows = t.events.withColumn("kind", F.expr("nullif(event_type, 'view')"))
    return quality.column_tests(rows, "events", not_null=["kind"], unique=["event_id", "user_id"])


@query("q10_assert_rows", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def assert_rows(t):
    rows = quality.assert_rows(t.lineitem, "l_quantity > 0 AND l_discount BETWEEN 0 AND 1", "bad quantity or discount")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("q10_failing_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0)")
def failing_rows(t):
    return quality.failing_rows(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal >= 0")


_LEFT = "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal < 9000"
_RIGHT = """SELECT c_custkey, CASE WHEN c_acctbal < 100 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
    c_acctbal FROM customer WHERE c_acctbal > -500"""


def _sides(t):
    columns = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
    right = t.customer.where("c_acctbal > -500").select(
        "c_custkey", F.expr("if(c_acctbal < 100, upper(c_name), c_name)").alias("c_name"), F.expr("if(c_acctbal < 0, NULL, c_mktsegment)").alias("c_mktsegment"), "c_acctbal"
    )
    return t.customer.where("c_acctbal < 9000").select(*columns), right


@query(
    "q11_compare",
    f"""SELECT * FROM (SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey, CASE WHEN r.c_custkey IS NULL THEN 'only_left' WHEN l.c_custkey IS NULL THEN 'only_right'
        WHEN l.c_name <> r.c_name OR l.c_mktsegment IS DISTINCT FROM r.c_mktsegment THEN 'changed' END AS difference,
        CASE WHEN l.c_custkey IS NULL OR r.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN l.c_name <> r.c_name THEN 'c_name' END,
          CASE WHEN l.c_mktsegment IS DISTINCT FROM r.c_mktsegment THEN 'c_mktsegment' END) END AS columns
        FROM ({_LEFT}) l FULL JOIN ({_RIGHT}) r ON l.c_custkey = r.c_custkey) WHERE difference IS NOT NULL""",
)
def compare(t):
    return quality.compare(*_sides(t), ["c_custkey"])


@query(
    "q11_compare_repeated",
    """WITH l AS (SELECT o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_totalprice > 400000), r AS (SELECT o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_totalprice > 350000),
       s AS (SELECT o_custkey, (SELECT count(*) FROM l WHERE l.o_custkey = k.o_custkey) AS nl, (SELECT count(*) FROM r WHERE r.o_custkey = k.o_custkey) AS nr,
         (SELECT any_value(l) FROM l WHERE l.o_custkey = k.o_custkey) AS a, (SELECT any_value(r) FROM r WHERE r.o_custkey = k.o_custkey) AS b
         FROM (SELECT o_custkey FROM l UNION SELECT o_custkey FROM r) k),
       d AS (SELECT o_custkey, CASE WHEN nl > 1 OR nr > 1 THEN 'repeated' WHEN nr = 0 THEN 'only_left' WHEN nl = 0 THEN 'only_right' WHEN a <> b THEN 'changed' END AS difference, a, b FROM s)
       SELECT o_custkey, difference, CASE WHEN difference = 'changed' THEN concat_ws(',', CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END,
         CASE WHEN a.o_orderdate <> b.o_orderdate THEN 'o_orderdate' END) ELSE '' END AS columns FROM d WHERE difference IS NOT NULL""",
)
def compare_repeated(t):
    side = lambda floor: t.orders.where(F.col("o_totalprice") > floor).select("o_custkey", "o_orderstatus", "o_orderdate")
    return quality.compare(side(400000), side(350000), ["o_custkey"])


@query(
    "q11_compare_bag",
    """SELECT l_partkey, CAST(sum(n) AS BIGINT) AS surplus FROM (SELECT l_partkey, 1 AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL
       SELECT l_partkey, -1 FROM lineitem WHERE l_returnflag = 'A') GROUP BY l_partkey HAVING sum(n) <> 0""",
)
def compare_bag(t):
    side = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select("l_partkey")
    return quality.compare_bag(side("R"), side("A"))
