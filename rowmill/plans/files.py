"""Sources and sinks: every sink is written from a table and read back with its source."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.plans.registry import query
from rowmill.session import scratch_path
from rowmill.sinks import files as out
from rowmill.sinks import tables as sinks
from rowmill.sources import files as src
from rowmill.sources import tables as tables


@query("s01_read_table", "SELECT c_custkey, c_name FROM customer")
def s01(t):
    t.customer.createOrReplaceTempView("rowmill_customer")
    return tables.read_table(t.spark, "rowmill_customer", ["c_custkey", "c_name"])


@query("s02_read_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def s02(t):
    sql = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > :floor AND o_orderstatus = :status"
    return tables.read_query(t.spark, sql, {"floor": 100000, "status": "F"}, orders=t.orders)


@query("s04_k03_delimited", "SELECT doc_id, text, lang, n_chars FROM documents")
def s04(t):
    path = scratch_path(t.spark, "csv")
    out.write_delimited(t.documents.select("doc_id", "text", "lang", "n_chars"), path, sep="\t", code_lines=True)
    return src.read_delimited(t.spark, path, "doc_id bigint, text string, lang string, n_chars bigint", sep="\t", code_lines=True)


@query("s04_quoted_lines", "SELECT doc_id, text, lang, n_chars FROM documents")
def s04_quoted(t):
    """Text with line ends inside quotes, as other writers leave it, read in parts."""
    path = scratch_path(t.spark, "csv")
    out.write_delimited(t.documents.select("doc_id", "text", "lang", "n_chars"), path)
    return src.read_delimited(t.spark, path, "doc_id bigint, text string, lang string, n_chars bigint", quoted_lines=True)


@query("s04_delimited_rejects", "SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id, event_type = 'error' AS bad FROM events")
def s04_rejects(t):
    path = scratch_path(t.spark, "csv")
    user = F.when(F.col("event_type") == "error", "none").otherwise(F.col("user_id").cast("string"))
    out.write_delimited(t.events.select("event_id", user.alias("user_id")), path, sep=";", header=False)
    rows = src.read_delimited(t.spark, path, "event_id bigint, user_id bigint", sep=";", header=False, keep_corrupt=True)
    return rows.select("event_id", "user_id", F.col(src.CORRUPT).isNotNull().alias("bad"))


@query("s05_k04_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def s05(t):
    path = scratch_path(t.spark, "json")
    out.write_json(t.events.select("event_id", "user_id", "event_type", "value", "props"), path)
    return src.read_json(t.spark, path, "event_id bigint, user_id bigint, event_type string, value double, props string")


@query("s06_k06_parquet", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def s06(t):
    path = scratch_path(t.spark, "parquet")
    out.write_parquet(t.lineitem, path, ["l_returnflag"])
    rows = src.read_parquet(t.spark, path, ["l_orderkey", "l_quantity", "l_returnflag"])
    return rows.where("l_returnflag = 'R' AND l_quantity > 25")


@query("s07_k05_xml", "SELECT p_partkey, p_name AS name, p_size AS size, p_brand AS brand FROM part")
def s07(t):
    path = scratch_path(t.spark, "xml")
    nested = t.part.select("p_partkey", "p_name", F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("info"))
    out.write_xml(nested, path, row_tag="part")
    rows = src.read_xml(t.spark, path, "part", "p_partkey bigint, p_name string, info struct<size: int, brand: string>")
    return rows.select("p_partkey", F.col("p_name").alias("name"), "info.size", "info.brand")


@query("s08_k07_positional", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def s08(t):
    path = scratch_path(t.spark, "text")
    out.write_positional(t.orders, path, [("o_orderkey", 12), ("o_orderpriority", 20), ("o_totalprice", 16)], right=["o_orderkey", "o_totalprice"], pad={"o_orderkey": "0"})
    fields = [("o_orderkey", 0, 12), ("o_orderpriority", 12, 20), ("o_totalprice", 32, 16)]
    return src.read_positional(t.spark, path, fields, {"o_orderkey": "bigint", "o_totalprice": "double"})


@query("s09_k08_full_row", "SELECT c_custkey || '|' || c_name AS line FROM customer")
def s09(t):
    path = scratch_path(t.spark, "text")
    out.write_full_row(t.customer.select(F.concat_ws("|", "c_custkey", "c_name").alias("x")), path, "x")
    return src.read_full_row(t.spark, path)


@query("s10_regex_file", "SELECT url, regexp_extract(url, '^(https?)://([^/]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host FROM pages WHERE url LIKE 'http%'")
def s10(t):
    path = scratch_path(t.spark, "text")
    out.write_full_row(t.pages, path, "url")
    return src.read_regex(t.spark, path, "^((https?)://([^/]+).*)", ["url", "scheme", "host"])


@query(
    "s11_ldif",
    "SELECT 'cn=' || c_name || ',ou=' || c_nationkey AS dn, c_name AS cn, 'a' || c_custkey || ',b' || c_custkey AS mails FROM customer",
)
def s11(t):
    path = scratch_path(t.spark, "ldif")
    key = F.col("c_custkey").cast("string")
    entry = F.concat(
        F.lit("dn: cn="), "c_name", F.lit(",ou="), F.col("c_nationkey").cast("string"), F.lit("\ncn: "), F.substring("c_name", 1, 9), F.lit("\n "), F.expr("substr(c_name, 10)"),
        F.lit("\nmail: a"), key, F.lit("\nmail: b"), key, F.lit("\n"),
    )
    out.write_full_row(t.customer.select(entry.alias("x")), path, "x")
    rows = src.read_ldif(t.spark, path)
    return rows.select("dn", F.col("attributes")["cn"][0].alias("cn"), F.array_join(F.col("attributes")["mail"], ",").alias("mails"))


@query("s14_iterated_files", "SELECT s_suppkey, true AS named FROM supplier UNION ALL SELECT c_custkey, true FROM customer")
def s14(t):
    path = scratch_path(t.spark, "files")
    out.write_parquet(t.supplier.select("s_suppkey"), f"{path}/a")
    out.write_parquet(t.customer.select(F.col("c_custkey").alias("s_suppkey")), f"{path}/b")
    rows = src.read_files(t.spark, f"{path}/*/*.parquet")
    return rows.select("s_suppkey", F.col("file_name").endswith(".parquet").alias("named"))


@query(
    "s15_stage",
    "SELECT c_mktsegment, count(*) AS n, CAST(sum(n_regionkey) AS BIGINT) AS regions FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
)
def s15(t):
    tables.stage(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_regionkey"), "rowmill_staged")
    return tables.staged(t.spark, "rowmill_staged").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("n_regionkey").alias("regions"))


@query("s17_run_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def s17(t):
    t.orders.createOrReplaceTempView("rowmill_orders")
    return tables.run_sql(t.spark, "SELECT o_orderstatus, count(*) AS n FROM rowmill_orders GROUP BY o_orderstatus")


@query("s18_k11_lake_path", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s18(t):
    uri = scratch_path(t.spark, "lake")
    out.write_lake_path(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), uri, "parquet")
    return src.read_lake_path(t.spark, uri, "parquet")


def _table_name():
    return f"rowmill_{uuid.uuid4().hex}"


@query("s19_load_as_table", "SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS loaded FROM events GROUP BY 1")
def s19(t):
    name = _table_name()
    loaded = src.load_as_table(t.spark, t.path("events"), "parquet", name, location=scratch_path(t.spark, "table"))
    return t.spark.table(name).groupBy("event_type").agg(F.count("*").alias("n"), F.lit(loaded).cast("bigint").alias("loaded"))


@query("k01_materialize", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def k01(t):
    view = sinks.materialize_as(t.orders.select("o_custkey"), "rowmill_keys")
    counted = view.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return sinks.materialize_as(counted, _table_name(), "table", path=scratch_path(t.spark, "table"), bucket_by=(8, "o_custkey"))


@query("k09_k10_ddl_elt", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey, s_name FROM supplier")
def k09(t):
    name = _table_name()
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])
    sinks.create_table(t.spark, name, schema, path=scratch_path(t.spark, "table"))
    sinks.elt_output(t.customer.where("c_acctbal > 0").select("c_name", "c_custkey"), name)
    sinks.elt_output(t.supplier.selectExpr("s_suppkey AS c_custkey", "s_name AS c_name"), name)
    return t.spark.table(name)
