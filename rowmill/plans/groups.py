"""Aggregation, windows, set operations and reshaping."""

from pyspark.sql import functions as F

from rowmill.operators import aggregate as agg
from rowmill.operators import dedup, reshape, sets
from rowmill.plans.registry import query
from rowmill.sources.tables import fixed_rows


@query(
    "a01_aggregate",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(l_orderkey) AS n, min(l_extendedprice) AS lowest,
       max(l_extendedprice) AS highest FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def a01(t):
    return agg.aggregate(
        t.lineitem, ["l_returnflag", "l_linestatus"],
        [("l_quantity", "sum", "qty"), ("l_orderkey", "count", "n"), ("l_extendedprice", "min", "lowest"), ("l_extendedprice", "max", "highest")],
    )


@query("a02_global", "SELECT round(sum(o_totalprice), 2) AS total, count(o_orderkey) AS n, max(o_orderdate) AS latest FROM orders")
def a02(t):
    out = agg.aggregate(t.orders, [], [("o_totalprice", "sum", "total"), ("o_orderkey", "count", "n"), ("o_orderdate", "max", "latest")])
    return out.withColumn("total", F.round("total", 2))


def _one(name, function, column, result, round_to=None):
    sql = f"SELECT o_custkey, {result} AS out FROM orders GROUP BY o_custkey"

    def run(t):
        out = agg.aggregate(t.orders, ["o_custkey"], [(column, function, "out")], order_by=["o_orderdate", "o_orderkey"])
        return out.withColumn("out", F.round("out", round_to)) if round_to is not None else out

    query(name, sql)(run)


_one("a03_sum", "sum", "o_totalprice", "round(sum(o_totalprice), 2)", 2)
_one("a05_min", "min", "o_totalprice", "min(o_totalprice)")
_one("a06_max", "max", "o_orderdate", "max(o_orderdate)")
_one("a08_first", "first", "o_orderkey", "arg_min(o_orderkey, (o_orderdate, o_orderkey))")
_one("a09_last", "last", "o_orderkey", "arg_max(o_orderkey, (o_orderdate, o_orderkey))")
_one("a10_list", "list", "o_orderpriority", "string_agg(o_orderpriority, ',' ORDER BY o_orderdate, o_orderkey)")
_one("a11_count_distinct", "count_distinct", "o_orderpriority", "count(DISTINCT o_orderpriority)")
_one("a13_median", "median", "o_totalprice", "round(median(o_totalprice), 3)", 3)


# Rows with NULL order keys, ties and groups of only NULLs; the same rows through the sorted copy that large groups take.
_GAPS = """(SELECT user_id % 97 AS g, CASE WHEN user_id % 97 < 9 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 5 END AS k, event_id, value FROM events)"""


def _gaps(t):
    return t.events.selectExpr(
        "user_id % 97 AS g", "CASE WHEN user_id % 97 < 9 THEN NULL ELSE event_type END AS kind", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 5 END AS k", "event_id", "value"
    )


def _twins(name, sql):
    """Register a query as it is and with every group taken for a large one."""

    def register(fn):
        query(name, sql)(lambda t: fn(t, None))
        query(f"{name}_sliced", sql)(lambda t: fn(t, 0))
        return fn

    return register


@_twins("a10_list_gaps", f"SELECT g, string_agg(kind, ',' ORDER BY k NULLS LAST, kind) AS kinds FROM {_GAPS} GROUP BY g")
def a10_gaps(t, hot):
    return agg.aggregate(_gaps(t), ["g"], [("kind", "list", "kinds")], ["k"], hot_rows=hot)


@_twins("a16_denormalize_gaps", f"SELECT k, string_agg(DISTINCT kind, ';' ORDER BY kind) AS kind FROM {_GAPS} GROUP BY k")
def a16_gaps(t, hot):
    return agg.denormalize(_gaps(t), ["k"], "kind", ";", dedup=True, hot_rows=hot)


@_twins("a13_median_gaps", f"SELECT k, median(value) AS middle, count(kind) AS n FROM {_GAPS} GROUP BY k")
def a13_gaps(t, hot):
    return agg.aggregate(_gaps(t), ["k"], [("value", "median", "middle"), ("kind", "count", "n")], hot_rows=hot)


@query(
    "a08_a09_first_last_gaps",
    f"""SELECT g, (list(kind ORDER BY k NULLS LAST, kind NULLS LAST))[1] AS earliest, (list(kind ORDER BY k NULLS LAST, kind NULLS LAST))[-1] AS latest FROM {_GAPS} GROUP BY g""",
)
def a08_a09_gaps(t):
    return agg.aggregate(_gaps(t), ["g"], [("kind", "first", "earliest"), ("kind", "last", "latest")], ["k"])


@_twins(
    "w03_first_rows_gaps",
    f"SELECT event_id, g FROM (SELECT *, row_number() OVER (PARTITION BY g % 3 ORDER BY k DESC NULLS LAST, event_id) AS rn FROM {_GAPS}) WHERE rn <= 200",
)
def w03_gaps(t, hot):
    rows = _gaps(t).selectExpr("event_id", "g", "g % 3 AS third", "k")
    return dedup.first_rows(rows, 200, ["third"], [("k", "desc"), "event_id"], tie=[], hot_rows=hot).select("event_id", "g")


@_twins(
    "w04_within_gaps", f"SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY kind NULLS LAST, event_id) AS seq FROM {_GAPS}",
)
def w04_gaps(t, hot):
    return dedup.sequence_within(_gaps(t), "seq", ["k"], ["kind", "event_id"], tie=[], hot_rows=hot).select("event_id", "seq")


@query(
    "a04_count",
    "SELECT o_custkey, count(nullif(o_orderstatus, 'P')) AS n FROM orders GROUP BY o_custkey",
)
def a04(t):
    rows = t.orders.select("o_custkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    return agg.aggregate(rows, ["o_custkey"], [("status", "count", "n")])


@query("a07_avg", "SELECT l_orderkey, avg(l_quantity) AS mean FROM lineitem GROUP BY l_orderkey")
def a07(t):
    return agg.aggregate(t.lineitem, ["l_orderkey"], [("l_quantity", "avg", "mean")])


@query("a12_stddev", "SELECT l_suppkey, round(stddev_samp(l_quantity), 8) AS spread FROM lineitem GROUP BY l_suppkey")
def a12(t):
    out = agg.aggregate(t.lineitem, ["l_suppkey"], [("l_quantity", "standard_deviation", "spread")])
    return out.withColumn("spread", F.round("spread", 8))


@query("a13_median_global", "SELECT median(l_quantity) AS middle, count(l_orderkey) AS n FROM lineitem")
def a13_global(t):
    return agg.aggregate(t.lineitem, [], [("l_quantity", "median", "middle"), ("l_orderkey", "count", "n")])


@query("a14_named_function", "SELECT l_partkey, round(var_samp(l_quantity), 8) AS spread FROM lineitem GROUP BY l_partkey")
def a14(t):
    return agg.aggregate(t.lineitem, ["l_partkey"], [("l_quantity", "VARIANCE", "spread")]).withColumn("spread", F.round("spread", 8))


@query("a15_aggregate_sorted", "SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey")
def a15(t):
    return agg.aggregate_sorted(t.lineitem, ["l_suppkey"], [("l_quantity", "sum", "qty")])


@query(
    "a16_denormalize",
    """SELECT l_orderkey, string_agg(k, ';' ORDER BY k) AS l_partkey FROM (SELECT DISTINCT l_orderkey, CAST(l_partkey AS VARCHAR) AS k FROM lineitem)
       GROUP BY l_orderkey""",
)
def a16(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("l_partkey"))
    return agg.denormalize(rows, ["l_orderkey"], "l_partkey", ";", dedup=True)


@query(
    "a16_denormalize_parts",
    "SELECT user_id, string_agg(event_type, ';' ORDER BY ts, event_id) AS event_type FROM events GROUP BY user_id",
)
def a16_parts(t):
    parts = agg.denormalize_parts(t.events, ["user_id"], "event_type", ";", ["ts", "event_id"])
    # Put together again so that the whole is compared.
    return agg.denormalize(parts, ["user_id"], "event_type", ";", order_by=["part"])


@query("a17_flow_meter", "SELECT 'rows' AS meter, count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def a17(t):
    metered, meter = agg.flow_meter(t.lineitem.where("l_returnflag = 'R'"))
    metered.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([("rows", meter.get["rows"])], "meter string, n bigint")


@query(
    "w01_dedup",
    """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def w01(t):
    return dedup.dedup(t.documents, ["text"], ["doc_id"], tie=[]).select("doc_id", "lang", "source")


@query(
    "w02_dedup_ignore_case",
    """SELECT doc_id, first_word FROM (SELECT *, row_number() OVER (PARTITION BY lower(first_word) ORDER BY doc_id) AS rn
       FROM (SELECT doc_id, string_split(text, ' ')[1] AS first_word FROM documents)) WHERE rn = 1""",
)
def w02(t):
    docs = t.documents.select("doc_id", F.split("text", " ")[0].alias("first_word"))
    return dedup.dedup(docs, ["first_word"], ["doc_id"], case_sensitive=False, tie=[])


@query(
    "w03_first_rows",
    """SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 3""",
)
def w03(t):
    return dedup.first_rows(t.events, 3, ["user_id"], ["ts", "event_id"], tie=[]).select("event_id", "user_id", "ts")


@query(
    "w03_first_rows_many",
    """SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 1500""",
)
def w03_many(t):
    rows = t.events.select("event_id", "event_type", "value")
    return dedup.first_rows(rows, 1500, ["event_type"], [("value", "desc"), "event_id"]).select("event_id", "event_type")


@query(
    "w04_sequence",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 100 + 5 * (row_number() OVER
       (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) AS seq FROM lineitem""",
)
def w04(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return dedup.sequence(t.lineitem.select(*keys), "seq", keys, start=100, step=5)


@query(
    "w04_sequence_within",
    "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq FROM events",
)
def w04_within(t):
    rows = t.events.select("event_id", "event_type", "ts")
    return dedup.sequence_within(rows, "seq", ["event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "u01_unite",
    """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0""",
)
def u01(t):
    c = t.customer.selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS balance")
    s = t.supplier.selectExpr("s_suppkey", "s_name", "s_acctbal")
    return sets.unite([c, s, c.where("balance < 0")])


@query(
    "u01_unite_by_name",
    "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
)
def u01_name(t):
    c = t.customer.selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    return sets.unite([c, t.supplier.selectExpr("s_name AS name", "s_suppkey AS key")], by="name")


@query("u02_intersect", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def u02(t):
    pairs = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey")
    return sets.intersect(pairs("R"), pairs("A"))


@query("u02_intersect_all", "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def u02_all(t):
    keys = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select("l_suppkey")
    return sets.intersect(keys("R"), keys("A"), all=True)


@query("u03_replicate", "SELECT 'a' AS copy, r_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY ALL UNION ALL SELECT 'b', n_name, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def u03(t):
    a, b = sets.replicate(t.nation, 2)
    left = a.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.lit("a").alias("copy"), "r_name").agg(F.count("*").alias("n"))
    right = b.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.lit("b").alias("copy"), "n_name").agg(F.count("*").alias("n"))
    return left.unionAll(right)


@query("r01_normalize", "SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS p_name FROM part")
def r01(t):
    return reshape.normalize(t.part.select("p_partkey", "p_name"), "p_name", " ")


@query(
    "r01_normalize_text",
    """SELECT doc_id, line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE line <> ''""",
)
def r01_text(t):
    return reshape.normalize(t.documents.select("doc_id", F.col("text").alias("line")), "line", "\n", drop_empty=True)


@query(
    "r02_pivot",
    """SELECT user_id, round(sum(CASE WHEN event_type = 'view' THEN value END), 2) AS view, round(sum(CASE WHEN event_type = 'click' THEN value END), 2) AS click,
       round(sum(CASE WHEN event_type = 'error' THEN value END), 2) AS error FROM events GROUP BY user_id""",
)
def r02(t):
    out = reshape.pivot(t.events, ["user_id"], "event_type", "value", "sum", ["view", "click", "error"])
    return out.select("user_id", *[F.round(c, 2).alias(c) for c in ("view", "click", "error")])


@query(
    "r03_unpivot",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem UNION ALL
       SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'l_discount', l_discount FROM lineitem UNION ALL
       SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'l_tax', l_tax FROM lineitem""",
)
def r03(t):
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return reshape.unpivot(t.lineitem, ids, ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


@query("r04_array_flatten", "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def r04(t):
    return reshape.array_flatten(t.embeddings.select("vec_id", "embedding"), "embedding")


@query(
    "s12_fixed_rows",
    """SELECT o_orderkey, label FROM orders JOIN (VALUES ('1-URGENT', 'now'), ('2-HIGH', 'soon'), ('5-LOW', 'later')) v(p, label) ON p = o_orderpriority""",
)
def s12(t):
    labels = fixed_rows(t.spark, [("1-URGENT", "now"), ("2-HIGH", "soon"), ("5-LOW", "later")], "p string, label string")
    return t.orders.join(labels, F.col("p") == F.col("o_orderpriority")).select("o_orderkey", "label")
