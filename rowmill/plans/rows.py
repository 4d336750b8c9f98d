"""Mapping, filtering, casting, extraction, sort and limit."""

from pyspark.sql import functions as F

from rowmill.operators import convert, custom, extract, filtering, mapping
from rowmill.operators.convert import Replacement
from rowmill.plans.registry import query
from rowmill.types import declared_schema


@query(
    "p01_map_columns",
    """SELECT l_orderkey AS order_key, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
       l_returnflag || '-' || l_linestatus AS flags FROM lineitem""",
)
def p01(t):
    return mapping.map_columns(
        t.lineitem,
        {
            "order_key": "l_orderkey",
            "charge": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6),
            "flags": "concat(l_returnflag, '-', l_linestatus)",
        },
    )


@query(
    "p02_map_variables",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice / l_quantity AS unit_price,
       CASE WHEN l_extendedprice / l_quantity > 1500 THEN 'HIGH' ELSE 'LOW' END AS band FROM lineitem""",
)
def p02(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return mapping.map_columns(
        t.lineitem,
        {**{k: k for k in keys}, "unit_price": "Var.unit", "band": "Var.band"},
        variables={"unit": "l_extendedprice / l_quantity", "band": "if(Var.unit > 1500, 'HIGH', 'LOW')"},
    )


@query(
    "p03_blank_expression",
    "SELECT c_custkey, CAST(NULL AS VARCHAR) AS remark, CAST(NULL AS INTEGER) AS score FROM customer",
)
def p03(t):
    return mapping.map_columns(t.customer, {"c_custkey": "c_custkey", "remark": "", "score": (None, "int")})


@query("p04_map_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def p04(t):
    return mapping.map_columns(
        t.orders, {"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"}, where="o_orderstatus = 'F' AND o_totalprice > 100000"
    )


def _outputs(t):
    orders = t.orders.withColumn("status", F.expr("nullif(o_orderstatus, 'P')"))
    columns = {"o_orderkey": "o_orderkey", "status": "status"}
    return mapping.map_outputs(
        orders,
        {
            "done": {"columns": columns, "where": "status = 'F'"},
            "large": {"columns": columns, "where": "status = 'O' AND o_totalprice > 100000"},
            "rest": {"columns": columns, "reject": True},
        },
    )


@query(
    "p05_map_outputs",
    """WITH o AS (SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders)
       SELECT 'done' AS output, o_orderkey, status FROM o WHERE status = 'F' UNION ALL
       SELECT 'large', o_orderkey, status FROM o WHERE status = 'O' AND o_totalprice > 100000""",
)
def p05(t):
    out = _outputs(t)
    tagged = [out[n].select(F.lit(n).alias("output"), "*") for n in ("done", "large")]
    return tagged[0].unionAll(tagged[1])


@query(
    "p06_output_reject",
    """WITH o AS (SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders)
       SELECT o_orderkey, status FROM o WHERE NOT coalesce(status = 'F' OR (status = 'O' AND o_totalprice > 100000), false)""",
)
def p06(t):
    return _outputs(t)["rest"]


@query("p07_filter_and", "SELECT * FROM part WHERE p_size >= 10 AND p_size < 40 AND p_type <> 'ECONOMY' AND contains(p_name, 'widget')")
def p07_and(t):
    return filtering.filter_rows(
        t.part, [("p_size", ">=", 10), ("p_size", "<", 40), ("p_type", "!=", "ECONOMY"), ("p_name", "CONTAINS", "widget")]
    )


@query("p07_filter_or", "SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#1[0-5]') OR p_size > 45 OR p_retailprice <= 950")
def p07_or(t):
    return filtering.filter_rows(
        t.part, [("p_brand", "MATCHES", "Brand#1[0-5]"), ("p_size", ">", 45), ("p_retailprice", "<=", 950.0)], "OR"
    ).select("p_partkey", "p_name", "p_brand")


@query(
    "p08_filter_reject",
    """WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders)
       SELECT * FROM o WHERE NOT coalesce(status = 'F', false)""",
)
def p08(t):
    orders = t.orders.select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    return filtering.split_rows(orders, [("status", "==", "F")]).reject


@query("p09_project", "SELECT c_name, c_custkey FROM customer")
def p09(t):
    return mapping.project(t.customer, ["c_name", "c_custkey"])


@query(
    "p10_sample_ranges",
    """SELECT event_id, ts FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events)
       WHERE rn BETWEEN 1 AND 5 OR rn = 10 OR rn BETWEEN 50 AND 99""",
)
def p10_ranges(t):
    return filtering.sample_rows(t.events, ["ts", "event_id"], ranges=[(1, 5), (10, 10), (50, 99)]).select("event_id", "ts")


@query(
    "p10_sample_every_nth",
    "SELECT event_id, ts FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 7 = 0",
)
def p10_nth(t):
    return filtering.sample_rows(t.events.select("event_id", "ts"), ["ts", "event_id"], every_nth=7)


_TEXT = """SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS raw FROM events"""


def _raw_events(t):
    raw = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("event_id").cast("string"))
    return t.events.select("event_id", raw.alias("raw"))


@query("p11_convert_types", f"SELECT event_id, TRY_CAST(raw AS BIGINT) AS raw FROM ({_TEXT}) WHERE TRY_CAST(raw AS BIGINT) IS NOT NULL")
def p11(t):
    return convert.convert_types(_raw_events(t), {"raw": "bigint"}).ok


@query("p11_convert_reject", f"SELECT event_id, raw FROM ({_TEXT}) WHERE TRY_CAST(raw AS BIGINT) IS NULL")
def p11_reject(t):
    return convert.convert_types(_raw_events(t), {"raw": "bigint"}).reject


@query(
    "p12_replace_values",
    """SELECT p_partkey, regexp_replace(replace(p_name, 'widget', 'gadget'), '(?i)\\bSMALL\\b', 'tiny', 'g') AS p_name,
       regexp_replace(p_brand, '#([0-9])$', '#0\\1', 'g') AS p_brand FROM part""",
)
def p12(t):
    rules = [
        Replacement("p_name", "widget", "gadget"),
        Replacement("p_name", "SMALL", "tiny", whole_word=True, ignore_case=True),
        Replacement("p_brand", "#([0-9])$", "#0$1", regex=True),
    ]
    return convert.replace_values(t.part, rules).select("p_partkey", "p_name", "p_brand")


_SCHEMA = declared_schema(
    [
        {"name": "event_id", "type": "id_Long", "nullable": False, "key": True},
        {"name": "raw", "type": "id_Integer"},
        {"name": "kind", "type": "id_String", "nullable": False, "length": 6},
    ]
)
_CHECKED = """SELECT event_id, CASE WHEN value > 150 THEN 'much' ELSE CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END AS raw,
              nullif(event_type, 'view') AS kind FROM events"""


def _checked(t):
    raw = F.when(F.col("value") > 150, "much").otherwise(F.floor("value").cast("int").cast("string"))
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    return convert.schema_check(t.events.select("event_id", raw.alias("raw"), kind.alias("kind")), _SCHEMA)


@query(
    "p13_schema_ok",
    f"""SELECT event_id, CAST(raw AS INTEGER) AS raw, kind FROM ({_CHECKED})
        WHERE TRY_CAST(raw AS INTEGER) IS NOT NULL AND kind IS NOT NULL AND length(kind) <= 6""",
)
def p13_ok(t):
    return _checked(t).ok


@query(
    "p13_schema_reject",
    f"""SELECT event_id, raw, kind,
        CAST((CASE WHEN TRY_CAST(raw AS INTEGER) IS NULL THEN 1 ELSE 0 END) + (CASE WHEN kind IS NULL THEN 2 ELSE 0 END)
          + (CASE WHEN length(kind) > 6 THEN 4 ELSE 0 END) AS INTEGER) AS "errorCode",
        concat_ws('; ', CASE WHEN TRY_CAST(raw AS INTEGER) IS NULL THEN 'raw: not int' END, CASE WHEN kind IS NULL THEN 'kind: is null' END,
          CASE WHEN length(kind) > 6 THEN 'kind: longer than 6' END) AS "errorMessage"
        FROM ({_CHECKED}) WHERE TRY_CAST(raw AS INTEGER) IS NULL OR kind IS NULL OR length(kind) > 6""",
)
def p13_reject(t):
    return _checked(t).reject


@query(
    "p14_replace_rows",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'BIG' ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_totalprice > 200000 THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders""",
)
def p14(t):
    out = mapping.replace_rows(t.orders, "o_totalprice > 200000", {"o_orderpriority": "'BIG'", "o_totalprice": "0"})
    return out.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "p15_mask",
    """SELECT c_custkey, sha256(c_name) AS c_name, regexp_replace(regexp_replace(regexp_replace(c_mktsegment, '[A-Z]', 'X', 'g'),
       '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_mktsegment FROM customer""",
)
def p15(t):
    return convert.mask(t.customer.select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "hash", "c_mktsegment": "mask"})


@query(
    "p15_mask_text",
    """SELECT doc_id, regexp_replace(text, '[0-9]', '#', 'g') AS digits,
       repeat('*', greatest(length(source) - 4, 0)) || right(source, 4) AS tail, left(lang, 1) || '***' AS initial FROM documents""",
)
def p15_text(t):
    docs = t.documents.select("doc_id", F.col("text").alias("digits"), F.col("source").alias("tail"), F.col("lang").alias("initial"))
    return convert.mask(docs, {"digits": "digits", "tail": "keep_last4", "initial": "initial"})


@query("p16_pattern_ok", "SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https://[a-z.]+/.*')")
def p16_ok(t):
    return convert.pattern_check(t.pages.select("page_id", "url"), "url", "https://[a-z.]+/.*").ok


@query("p16_pattern_reject", "SELECT page_id, url FROM pages WHERE NOT regexp_full_match(url, 'https://[a-z.]+/.*')")
def p16_reject(t):
    return convert.pattern_check(t.pages.select("page_id", "url"), "url", "https://[a-z.]+/.*").reject


@query(
    "p17_extract_regex",
    """SELECT page_id, CASE WHEN ok THEN regexp_extract(url, p, 1) END AS scheme, CASE WHEN ok THEN regexp_extract(url, p, 2) END AS host,
       CASE WHEN ok THEN regexp_extract(url, p, 3) END AS lang FROM (SELECT page_id, url, '^(https?)://([^/]+)/([a-z][a-z])/' AS p,
       regexp_matches(url, '^(https?)://([^/]+)/([a-z][a-z])/') AS ok FROM pages)""",
)
def p17(t):
    out = extract.extract_regex(t.pages, "url", "^(https?)://([^/]+)/([a-z][a-z])/", ["scheme", "host", "lang"])
    return out.select("page_id", "scheme", "host", "lang")


@query(
    "p18_extract_delimited",
    """SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word, string_split(p_name, ' ')[2] AS second_word,
       string_split(p_name, ' ')[3] AS third_word FROM part""",
)
def p18(t):
    out = extract.extract_delimited(t.part, "p_name", " ", ["first_word", "second_word", "third_word"])
    return out.select("p_partkey", "first_word", "second_word", "third_word")


@query(
    "p19_extract_positional",
    """SELECT c_custkey, trim(substr(c_name, 1, 8)) AS prefix, trim(substr(c_name, 9, 1)) AS mark, trim(substr(c_name, 10, 9)) AS number
       FROM customer""",
)
def p19(t):
    out = extract.extract_positional(t.customer, "c_name", [("prefix", 0, 8), ("mark", 8, 1), ("number", 9, 9)])
    return out.select("c_custkey", "prefix", "mark", "number")


@query(
    "p20_extract_xml",
    """SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS missing FROM part""",
)
def p20(t):
    xml = F.concat(F.lit("<part><name>"), "p_name", F.lit('</name><info size="'), F.col("p_size").cast("string"), F.lit('"/></part>'))
    docs = t.part.select("p_partkey", xml.alias("doc"))
    return extract.extract_xml(docs, "doc", {"name": "part/name", "size": "part/info/@size", "missing": "part/none"}).drop("doc")


@query("p21_extract_json", "SELECT event_id, props ->> '$.k' AS k, props ->> '$.none' AS none FROM events")
def p21(t):
    return extract.extract_json(t.events, "props", {"k": "$.k", "none": "$.none"}).select("event_id", "k", "none")


@query(
    "p21_extract_json_loop",
    """SELECT p_partkey, w AS word, length(w)::VARCHAR AS size FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)""",
)
def p21_loop(t):
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word"), F.length(w).alias("size")))
    docs = t.part.select("p_partkey", F.to_json(F.struct(words.alias("words"))).alias("doc"))
    return extract.extract_json(docs, "doc", {"word": "$.word", "size": "$.size"}, loop="$.words").drop("doc")


@query(
    "p22_map_xml",
    """SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, p_size AS size FROM part""",
)
def p22(t):
    words = F.array_join(
        F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("<w><word>"), w, F.lit("</word><size>"), F.col("p_size").cast("string"), F.lit("</size></w>"))), ""
    )
    docs = t.part.select("p_partkey", F.concat(F.lit("<part>"), words, F.lit("</part>")).alias("doc"))
    return extract.map_xml(docs, "doc", "w ARRAY<STRUCT<word: STRING, size: INT>>", loop="w")


@query("p22_xml_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def p22_back(t):
    docs = extract.build_xml(t.customer.select("c_custkey", "c_name", "c_acctbal"), ["c_name", "c_acctbal"], "doc")
    return extract.map_xml(docs, "doc", "c_name STRING, c_acctbal DOUBLE")


@query(
    "p24_custom_rows",
    """SELECT o_orderkey, upper(o_orderpriority) AS label, length(upper(o_orderpriority)) % 5 AS bucket FROM orders""",
)
def p24(t):
    rows = custom.custom_rows(t.orders.select("o_orderkey", "o_orderpriority"), {"label": "upper(o_orderpriority)", "bucket": "cast(length(label) % 5 AS bigint)"})
    return rows.drop("o_orderpriority")


@query("p26_count_loop", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest(range(1, l_linenumber + 1)) AS iteration FROM lineitem")
def p26(t):
    return mapping.count_loop(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_linenumber")


@query(
    "p27_with_context",
    "SELECT o_orderkey, 'EU' AS region, o_totalprice * 2 AS doubled FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'",
)
def p27(t):
    rows = mapping.with_context(t.orders, {"floor": 150000, "status": "O", "region": "EU", "factor": 2})
    return mapping.map_columns(
        rows,
        {"o_orderkey": "o_orderkey", "region": "context.region", "doubled": "o_totalprice * context.factor"},
        where="o_totalprice > context.floor AND o_orderstatus = context.status",
    )


@query(
    "p27_load_context",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT max(c_acctbal) * 10 FROM customer) AND o_orderstatus = 'O'",
)
def p27_load(t):
    rows = t.customer.agg(F.max("c_acctbal").alias("m")).select(F.lit("floor").alias("key"), (F.col("m") * 10).alias("value"))
    rows = mapping.with_context(t.orders, mapping.load_context(rows, ["floor"]))
    return rows.where("o_totalprice >= context.floor AND o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")


@query("o01_sort", "SELECT n_nationkey, nullif(n_name, 'NATION_3') AS n_name, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def o01(t):
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select("n_nationkey", F.expr("nullif(n_name, 'NATION_3')").alias("n_name"), "c_custkey")
    return filtering.sort_rows(rows, ["n_name", ("c_custkey", "desc")])


@query("o02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o02(t):
    return filtering.limit_rows(t.orders.select("o_orderkey", "o_totalprice"), 100, [("o_totalprice", "desc"), "o_orderkey"])


@query("x01_custom_expressions", "SELECT event_id, value * 2 AS twice, CASE WHEN value * 2 > 100 THEN 'high' ELSE 'low' END AS band FROM events")
def x01(t):
    return custom.custom_rows(t.events.select("event_id", "value"), {"twice": "value * 2", "band": "if(twice > 100, 'high', 'low')"}).drop("value")


@query(
    "x02_custom_batches",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') || '/' || event_type AS tag, value * 1.5 AS scaled FROM events",
)
def x02(t):
    def tag(batch, factor):
        out = batch[["event_id"]].copy()
        out["tag"] = batch["ts"].dt.strftime("%Y-%m-%d") + "/" + batch["event_type"]
        out["scaled"] = batch["value"] * factor
        return out

    source = t.events.select("event_id", "ts", "event_type", "value")
    return custom.custom_batches(source, tag, "event_id bigint, tag string, scaled double", begin=lambda: 1.5)


@query("x03_custom_table", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def x03(t):
    def words(batch):
        out = batch.assign(word=batch["p_name"].str.split(" ")).explode("word")
        return out[["p_partkey", "word"]]

    return custom.custom_table(t.part.select("p_partkey", "p_name"), words, "p_partkey bigint, word string")


