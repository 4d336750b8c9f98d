"""Lineage over job descriptions derived from the test tables.

A part job feeds order jobs, these feed customer jobs, then nation jobs, then region jobs.
"""

from pyspark.sql import functions as F

from rowmill.operators import lineage
from rowmill.plans.registry import query
from rowmill.sources.tables import fixed_rows


def _name(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _component(df, job, kind, table=None, sql=None):
    empty = F.lit(None).cast("string")
    return df.select(
        job.alias("job"), F.lit(kind).alias("kind"), (empty if table is None else table).alias("table_name"), (empty if sql is None else sql).alias("query")
    )


def _components(t):
    """Order jobs read parts through stored SQL; the others name their tables."""
    sql = F.concat(
        F.lit("SELECT a.*&#10;FROM `dw`.Part_"), F.col("l_partkey").cast("string"), F.lit(" a\\nJOIN raw.codes c ON a.k &lt; c.k AND EXISTS (SELECT 1 FROM dual)")
    )
    parts = [
        _component(t.part, _name("p", "p_partkey"), "DATA_SINK", F.concat(F.lit('"dw"."PART_'), F.col("p_partkey").cast("string"), F.lit('"'))),
        _component(t.lineitem, _name("o", "l_orderkey"), "DATA_SOURCE", sql=sql),
        _component(t.orders, _name("o", "o_orderkey"), "DATA_SINK", _name("dw.cust_", "o_custkey")),
        _component(t.customer, _name("c", "c_custkey"), "DATA_SOURCE", _name("cust_", "c_custkey")),
        _component(t.customer, _name("c", "c_custkey"), "DATA_SINK", _name("nation_", "c_nationkey")),
        _component(t.nation, _name("n", "n_nationkey"), "SQL_EXEC", sql=F.concat(F.lit("insert into x select * from nation_"), F.col("n_nationkey").cast("string"))),
        _component(t.nation, _name("n", "n_nationkey"), "DATA_SINK", _name("region_", "n_regionkey")),
        _component(t.region, _name("r", "r_regionkey"), "DATA_SOURCE", _name("Region_", "r_regionkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


_ACCESS = """access(job, access, table_name) AS (
  SELECT 'p' || p_partkey, 'write', 'part_' || p_partkey FROM part UNION SELECT 'o' || l_orderkey, 'read', 'part_' || l_partkey FROM lineitem
  UNION SELECT 'o' || l_orderkey, 'read', 'codes' FROM lineitem UNION SELECT 'o' || o_orderkey, 'write', 'cust_' || o_custkey FROM orders
  UNION SELECT 'c' || c_custkey, 'read', 'cust_' || c_custkey FROM customer UNION SELECT 'c' || c_custkey, 'write', 'nation_' || c_nationkey FROM customer
  UNION SELECT 'n' || n_nationkey, 'read', 'nation_' || n_nationkey FROM nation UNION SELECT 'n' || n_nationkey, 'write', 'region_' || n_regionkey FROM nation
  UNION SELECT 'r' || r_regionkey, 'read', 'region_' || r_regionkey FROM region)"""


@query(
    "l01_extract_tables",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest(['part_' || l_partkey, 'codes']) AS table_name FROM lineitem""",
)
def l01(t):
    sql = F.concat(F.lit("SELECT a.*&#10;FROM `dw`.Part_"), F.col("l_partkey").cast("string"), F.lit(" a\\nJOIN raw.codes c ON a.k &lt; c.k from dual"))
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return lineage.extract_tables(t.lineitem.select(*keys, sql.alias("query")), "query").drop("query")


@query("l02_job_reads_writes", f"WITH {_ACCESS} SELECT job, access, table_name FROM access")
def l02(t):
    return lineage.job_reads_writes(_components(t))


@query(
    "l03_data_edges",
    """SELECT DISTINCT 'p' || p_partkey AS writer, 'o' || l_orderkey AS reader, 'part_' || p_partkey AS table_name FROM part JOIN lineitem ON l_partkey = p_partkey
       UNION ALL SELECT 'o' || o_orderkey, 'c' || c_custkey, 'cust_' || c_custkey FROM orders JOIN customer ON c_custkey = o_custkey
       UNION ALL SELECT 'c' || c_custkey, 'n' || n_nationkey, 'nation_' || n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey
       UNION ALL SELECT 'n' || n_nationkey, 'r' || r_regionkey, 'region_' || r_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def l03(t):
    return lineage.data_edges(lineage.job_reads_writes(_components(t)))


@query(
    "l03_table_links",
    f"""WITH {_ACCESS}, w AS (SELECT table_name, count(DISTINCT job) AS n_writers FROM access WHERE access = 'write' GROUP BY table_name),
        r AS (SELECT table_name, count(DISTINCT job) AS n_readers FROM access WHERE access = 'read' GROUP BY table_name),
        b AS (SELECT table_name, count(*) AS n FROM (SELECT table_name, job FROM access GROUP BY table_name, job HAVING count(DISTINCT access) = 2) GROUP BY table_name)
        SELECT table_name, n_writers, n_readers, n_writers * n_readers - coalesce(n, 0) AS n_edges FROM w JOIN r USING (table_name) LEFT JOIN b USING (table_name)
        WHERE n_writers * n_readers > coalesce(n, 0)""",
)
def l03_links(t):
    return lineage.table_links(lineage.job_reads_writes(_components(t)))


_NEEDED = f"""WITH RECURSIVE {_ACCESS}, e AS (SELECT DISTINCT w.job AS writer, r.job AS reader FROM access w JOIN access r USING (table_name) WHERE w.access = 'write' AND r.access = 'read'),
  connected AS (SELECT 'r' || r_regionkey AS job FROM region WHERE r_name = 'EUROPE'),
  needed AS (SELECT job FROM connected UNION SELECT e.writer FROM needed JOIN e ON e.reader = needed.job)"""


def _connected(t):
    return t.region.where("r_name = 'EUROPE'").select(_name("r", "r_regionkey").alias("job"))


@query("l04_needed_jobs", f"{_NEEDED} SELECT job FROM needed")
def l04(t):
    return lineage.needed_jobs(lineage.job_reads_writes(_components(t)), _connected(t))


@query(
    "l04_dead_jobs",
    f"""{_NEEDED} SELECT DISTINCT a.job, CASE WHEN c.job IS NOT NULL THEN 'connected' WHEN n.job IS NOT NULL THEN 'data_dependent' ELSE 'dead' END AS status
        FROM access a LEFT JOIN connected c USING (job) LEFT JOIN needed n USING (job)""",
)
def l04_dead(t):
    return lineage.classify_jobs(lineage.job_reads_writes(_components(t)), None, _connected(t))


def _tree(t):
    """region -> nation -> customer -> order"""
    return (
        t.nation.select(_name("r", "n_regionkey").alias("src"), _name("n", "n_nationkey").alias("dst"))
        .unionAll(t.customer.select(_name("n", "c_nationkey"), _name("c", "c_custkey")))
        .unionAll(t.orders.select(_name("c", "o_custkey"), _name("o", "o_orderkey")))
    )


_TREE = """edges(src, dst) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


@query(
    "l05_roots_leaves",
    f"""WITH {_TREE}, ends AS (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges UNION ALL SELECT 's' || s_suppkey, 0, 0 FROM supplier)
        SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree,
        CASE WHEN sum(i) = 0 AND sum(o) = 0 THEN 'orphan' WHEN sum(i) = 0 THEN 'root' WHEN sum(o) = 0 THEN 'leaf' ELSE 'inner' END AS role FROM ends GROUP BY node""",
)
def l05(t):
    return lineage.degrees(t.supplier.select(_name("s", "s_suppkey").alias("node")), _tree(t))


@query(
    "l06_levels",
    """WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 1 ELSE 0 END AS v FROM orders),
       c AS (SELECT c_custkey, c_nationkey, coalesce((SELECT max(v) + 1 FROM o WHERE o_custkey = c_custkey), 0) AS v FROM customer),
       n AS (SELECT n_nationkey, n_regionkey, CASE WHEN r_name <> 'ASIA' THEN coalesce((SELECT max(v) + 1 FROM c WHERE c_nationkey = n_nationkey), 0) END AS v
         FROM nation JOIN region ON r_regionkey = n_regionkey),
       r AS (SELECT r_regionkey, CASE WHEN r_name <> 'ASIA' THEN coalesce((SELECT max(v) + 1 FROM n WHERE n_regionkey = r_regionkey), 0) END AS v FROM region)
       SELECT node, CAST(v AS INTEGER) AS level FROM (SELECT 'o' || o_orderkey AS node, v FROM o UNION ALL SELECT 'c' || c_custkey, v FROM c UNION ALL SELECT 'n' || n_nationkey, v FROM n
       UNION ALL SELECT 'r' || r_regionkey, v FROM r UNION ALL SELECT 'p' || p_partkey, 0 FROM part)""",
)
def l06(t):
    return lineage.levels(t.part.select(_name("p", "p_partkey").alias("node")), _cyclic(t))


@query(
    "l06_cycles",
    """SELECT 'n' || n_nationkey AS node FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'
       UNION SELECT 'r' || r_regionkey FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'""",
)
def l06_cycles(t):
    # A line that leaves the cycle again: its nodes are behind it, not on it.
    tail = t.region.where("r_name = 'ASIA'").select(_name("r", "r_regionkey").alias("src"), _name("t", "r_regionkey").alias("dst"))
    return lineage.cycles(_cyclic(t).unionAll(tail))


def _cyclic(t):
    edges = (
        t.lineitem.select(_name("p", "l_partkey").alias("src"), _name("o", "l_orderkey").alias("dst"))
        .unionAll(t.orders.select(_name("o", "o_orderkey"), _name("c", "o_custkey")))
        .unionAll(t.customer.select(_name("c", "c_custkey"), _name("n", "c_nationkey")))
        .unionAll(t.nation.select(_name("n", "n_nationkey"), _name("r", "n_regionkey")))
    )
    # Asia also feeds its nations: a cycle.
    asia = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey"))
    return edges.unionAll(asia.select(_name("r", "n_regionkey"), _name("n", "n_nationkey")))


@query(
    "l06_max_depth",
    f"""WITH RECURSIVE {_TREE}, walk(node, depth) AS (SELECT DISTINCT src, 0 FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION
        SELECT dst, depth + 1 FROM walk JOIN edges ON src = node) SELECT CAST(max(depth) AS BIGINT) AS max_depth FROM walk""",
)
def l06_depth(t):
    return lineage.max_depth(t.region.select(_name("r", "r_regionkey").alias("node")), _tree(t))


_BEHAVIOR = """SELECT p_partkey, p_name, CASE p_name WHEN 'hot rod' THEN 'CAR' WHEN 'blue ring' THEN 'JEWEL' ELSE CASE WHEN p_name LIKE '%ld widget' THEN 'COLD'
    WHEN p_name LIKE '%widget' THEN 'GADGET' WHEN p_name LIKE '%ring' THEN 'ROUND' WHEN p_name LIKE '%rod' THEN 'LONG' ELSE 'UNKNOWN' END END AS behavior FROM part"""


def _classified(t):
    exact = fixed_rows(t.spark, [("hot rod", "CAR"), ("blue ring", "JEWEL")], "name string, class string")
    suffixes = fixed_rows(t.spark, [("widget", "GADGET"), ("ld widget", "COLD"), ("ring", "ROUND"), ("rod", "LONG")], "suffix string, class string")
    return lineage.classify(t.part.select("p_partkey", "p_name"), "p_name", exact, suffixes, "UNKNOWN")


@query("l07_classify", _BEHAVIOR)
def l07(t):
    return _classified(t)


@query("l08_class_counts", f"SELECT behavior, count(*) AS n FROM ({_BEHAVIOR}) GROUP BY behavior")
def l08(t):
    return lineage.class_counts(_classified(t), "behavior")


@query(
    "l09_confidence",
    """SELECT job, total, deterministic, CASE WHEN total > 0 THEN deterministic / total * 100 ELSE 100.0 END AS deterministic_pct FROM (
       SELECT l_orderkey AS job, count(*) FILTER (b NOT IN ('IGNORE')) AS total, count(*) FILTER (b NOT IN ('IGNORE', 'CUSTOM_CODE') AND l_discount * 10 >= 0.5) AS deterministic
       FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'IGNORE' WHEN 'A' THEN 'CUSTOM_CODE' ELSE 'FILTER' END AS b FROM lineitem) GROUP BY l_orderkey)""",
)
def l09(t):
    behavior = F.when(F.col("l_returnflag") == "R", "IGNORE").when(F.col("l_returnflag") == "A", "CUSTOM_CODE").otherwise("FILTER")
    rows = t.lineitem.select(F.col("l_orderkey").alias("job"), behavior.alias("behavior"), (F.col("l_discount") * 10).alias("confidence"))
    return lineage.confidence(rows)


@query(
    "l09_expression_coverage",
    """SELECT l_orderkey AS job, 1.0::DOUBLE - count(*) FILTER (l_returnflag = 'R') / count(*) AS confidence FROM lineitem GROUP BY 1""",
)
def l09_coverage(t):
    strategy = F.when(F.col("l_returnflag") == "R", "REVIEW").otherwise("RULE")
    return lineage.expression_coverage(t.lineitem.select(F.col("l_orderkey").alias("job"), strategy.alias("strategy")), "REVIEW")


@query(
    "l10_dominant",
    """SELECT user_id, event_type AS dominant FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(ts)) AS rn
       FROM events GROUP BY user_id, event_type) WHERE rn = 1""",
)
def l10(t):
    return lineage.dominant(t.events, ["user_id"], "event_type", "ts")


@query(
    "l11_source_catalogue",
    "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def l11(t):
    return lineage.source_catalogue(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")
