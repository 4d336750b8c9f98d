"""Scalar functions, one query per family; columns are named after the function they show."""

from pyspark.sql import functions as F

from rowmill.functions import dates as d
from rowmill.functions import logic as g
from rowmill.functions import numbers as n
from rowmill.functions import strings as s
from rowmill.functions import system
from rowmill.operators import dedup
from rowmill.plans.registry import query


@query(
    "f001_f008_system",
    """SELECT o_orderkey, true AS today_ok, true AS start_ok, 'run-1' AS pid, 'run-1' AS root_pid, 'run-1' AS father_pid, 'load' AS job_name, 'mill' AS project_name,
       'prod' AS context_str, '1.0' AS job_version, false AS is_child, '' AS root_dir, true AS now_ok, true AS random_ok, true AS millis_ok, 'Linux' AS os_name FROM orders""",
)
def system_values(t):
    run = system.Run(job_name="load", project_name="mill", context="prod", run_id="run-1")
    drawn = n.random_int()
    return t.orders.select(
        "o_orderkey",
        (run.variable("currentDate") >= F.to_date(F.lit("2024-01-01"))).alias("today_ok"),
        (run.variable("startTime") >= F.to_timestamp(F.lit("2024-01-01"))).alias("start_ok"),
        run.variable("Pid").alias("pid"), run.variable("rootPid").alias("root_pid"), run.variable("fatherPid").alias("father_pid"),
        run.variable("jobName").alias("job_name"), run.variable("projectName").alias("project_name"),
        run.variable("contextStr").alias("context_str"), run.variable("jobVersion").alias("job_version"),
        run.variable("isChildJob").alias("is_child"), run.variable("rootDir").alias("root_dir"),
        (d.now().cast("date") >= d.current_date()).alias("now_ok"),
        drawn.between(0, 2147483646).alias("random_ok"),
        (d.current_millis() > 1_700_000_000_000).alias("millis_ok"),
        system.os_name().alias("os_name"),
    )


@query(
    "f010_f012_format_parse",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS iso_day, strftime(ts, '%d/%m/%Y %H:%M:%S') AS european, strftime(ts, '%Y%m') AS year_month,
       date_trunc('second', ts)::TIMESTAMP AS parsed, date_trunc('day', ts)::TIMESTAMP AS parsed_day FROM events""",
)
def format_parse(t):
    text = t.events.select("event_id", "ts", d.format_date("dd/MM/yyyy HH:mm:ss", "ts").alias("european"))
    return text.select(
        "event_id", d.format_date("yyyy-MM-dd", "ts").alias("iso_day"), "european",
        d.format_date_locale("yyyyMM", "ts", "en").alias("year_month"),
        d.parse_date("dd/MM/yyyy HH:mm:ss", "european").alias("parsed"),
        d.parse_date_locale("dd/MM/yyyy", F.substring("european", 1, 10), "en").alias("parsed_day"),
    )


@query(
    "f013_f014_add_date",
    """SELECT event_id, ts + INTERVAL 1 YEAR AS years, ts + INTERVAL (-1) MONTH AS months, ts + INTERVAL 45 DAY AS days, ts + INTERVAL 30 HOUR AS hours,
       ts + INTERVAL 90 MINUTE AS minutes, ts - INTERVAL 10 SECOND AS seconds, ts + to_days(CAST(user_id AS INTEGER)) AS by_column,
       ts + INTERVAL 1 MONTH AS month_word FROM events""",
)
def add_date(t):
    return t.events.select(
        "event_id", d.add_date("ts", 1, "yyyy").alias("years"), d.add_date("ts", -1, "MM").alias("months"),
        d.add_date("ts", 45, "dd").alias("days"), d.add_date("ts", 30, "HH").alias("hours"),
        d.add_date("ts", 90, "mm").alias("minutes"), d.add_date("ts", -10, "ss").alias("seconds"),
        d.add_date("ts", F.col("user_id"), "dd").alias("by_column"), d.add_to_date("ts", "MONTH", 1).alias("month_word"),
    )


_PIVOT_TIME = "2024-01-15 12:30:30"


@query(
    "f015_f016_diff_date",
    f"""SELECT event_id, date_diff('year', p, ts) AS years, date_diff('month', p, ts) AS months, date_diff('day', p, ts) AS days,
       date_diff('hour', p, ts) AS hours, date_diff('minute', p, ts) AS minutes, date_diff('second', p, ts) AS seconds,
       date_sub('month', p, ts) AS whole_months, date_sub('day', p, ts) AS whole_days, date_sub('hour', p, ts) AS whole_hours
       FROM (SELECT *, TIMESTAMP '{_PIVOT_TIME}' AS p FROM events)""",
)
def diff_date(t):
    rows = t.events.withColumn("p", F.lit(_PIVOT_TIME).cast("timestamp_ntz"))
    units = {"years": "yyyy", "months": "MM", "days": "dd", "hours": "HH", "minutes": "mm", "seconds": "ss"}
    return rows.select(
        "event_id", *[d.diff_date("ts", "p", u).alias(c) for c, u in units.items()],
        d.diff_date_floor("ts", "p", "MM").alias("whole_months"), d.diff_date_floor("ts", "p", "dd").alias("whole_days"),
        d.diff_date_floor("ts", "p", "HH").alias("whole_hours"),
    )


@query(
    "f015_diff_order_ship",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, date_diff('year', o_orderdate, l_shipdate) AS years,
       date_diff('month', o_orderdate, l_shipdate) AS months, date_diff('day', o_orderdate, l_shipdate) AS days,
       date_diff('month', o_orderdate, l_shipdate) - CASE WHEN l_shipdate >= o_orderdate AND day(l_shipdate) < day(o_orderdate) THEN 1
         WHEN l_shipdate < o_orderdate AND day(l_shipdate) > day(o_orderdate) THEN -1 ELSE 0 END AS whole_months FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def diff_order_ship(t):
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", d.diff_date("l_shipdate", "o_orderdate", "yyyy").alias("years"),
        d.diff_date("l_shipdate", "o_orderdate", "MM").alias("months"), d.diff_date("l_shipdate", "o_orderdate").alias("days"),
        d.diff_date_floor("l_shipdate", "o_orderdate", "MM").alias("whole_months"),
    )


@query(
    "f017_f019_compare_parts",
    f"""SELECT event_id, CASE WHEN CAST(ts AS DATE) < CAST(p AS DATE) THEN -1 WHEN CAST(ts AS DATE) = CAST(p AS DATE) THEN 0 ELSE 1 END AS by_day,
       CASE WHEN ts < p THEN -1 WHEN ts = p THEN 0 ELSE 1 END AS by_time, CASE WHEN ts < q THEN -1 WHEN ts = q THEN 0 ELSE 1 END AS with_null,
       extract(year FROM ts) AS y, extract(month FROM ts) - 1 AS m0, extract(day FROM ts) AS dd, extract(hour FROM ts) AS h, extract(minute FROM ts) AS mi,
       extract(second FROM ts) AS s, extract(doy FROM ts) AS doy, extract(dow FROM ts) AS dow, extract(week FROM ts) AS w, extract(quarter FROM ts) AS q
       FROM (SELECT *, TIMESTAMP '{_PIVOT_TIME}' AS p, CASE WHEN event_type = 'view' THEN ts END AS q FROM events)""",
)
def compare_parts(t):
    rows = t.events.withColumn("p", F.lit(_PIVOT_TIME).cast("timestamp_ntz")).withColumn("q", F.when(F.col("event_type") == "view", F.col("ts")))
    parts = {"y": "YEAR", "m0": "MONTH", "dd": "DAY", "h": "HOUR", "mi": "MINUTE", "s": "SECOND", "doy": "DAY_OF_YEAR", "dow": "DOW", "w": "WEEK_OF_YEAR", "q": "QUARTER"}
    return rows.select(
        "event_id", d.compare_date("ts", "p", "yyyy-MM-dd").alias("by_day"), d.compare_date("ts", "p").alias("by_time"),
        d.compare_date("ts", "q").alias("with_null"), *[d.part_of_date(p, "ts").alias(c) for c, p in parts.items()],
    )


@query(
    "f020_f025_month_ends_checks",
    """SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS first_day, last_day(ts) AS last_day, strftime(ts, '%H.%M') AS clock,
       try_strptime(raw, '%Y-%m-%d') IS NOT NULL AS is_day, strptime(strftime(ts, '%d-%m-%Y'), '%d-%m-%Y') AS to_date, strftime(ts, '%Y/%m/%d') AS to_char
       FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'no day' WHEN event_type = 'click' THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS raw FROM events)""",
)
def month_ends(t):
    raw = F.when(F.col("event_type") == "error", "no day").when(F.col("event_type") != "click", d.format_date("yyyy-MM-dd", "ts"))
    rows = t.events.withColumn("raw", raw)
    return rows.select(
        "event_id", d.first_day_of_month("ts").alias("first_day"), d.last_day_of_month("ts").alias("last_day"),
        d.format_date_locale("HH.mm", "ts", "de").alias("clock"), d.is_date("raw", "yyyy-MM-dd").alias("is_day"),
        d.to_date(d.format_date("dd-MM-yyyy", "ts"), "dd-MM-yyyy").alias("to_date"), d.to_char("ts", "yyyy/MM/dd").alias("to_char"),
    )


@query(
    "f030_f039_strings",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS down, trim(padded) AS trimmed, ltrim(padded) AS ltrimmed, rtrim(padded) AS rtrimmed, length(padded) AS len,
       left(p_name, 4) AS lft, right(p_name, 4) AS rgt, substring(p_name, 3, 5) AS sub, strpos(p_name, 'widget') - 1 AS idx, strpos(p_name, 'zzz') - 1 AS absent
       FROM (SELECT *, '  ' || p_name || ' ' AS padded FROM part)""",
)
def strings(t):
    rows = t.part.withColumn("padded", F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return rows.select(
        "p_partkey", s.upcase("p_name").alias("up"), s.downcase("p_brand").alias("down"), s.trim("padded").alias("trimmed"),
        s.ltrim("padded").alias("ltrimmed"), s.rtrim("padded").alias("rtrimmed"), s.length("padded").cast("bigint").alias("len"),
        s.left("p_name", 4).alias("lft"), s.right("p_name", 4).alias("rgt"), s.substr("p_name", 2, 5).alias("sub"),
        s.index("p_name", "widget").cast("bigint").alias("idx"), s.index("p_name", "zzz").cast("bigint").alias("absent"),
    )


@query(
    "f040_f052_strings",
    """SELECT doc_id, replace(text, 'th', 'TH') AS changed, regexp_replace(text, '([aeiou])\\s+', '\\1_', 'g') AS ereplaced,
       CAST((length(text) - length(replace(text, 'en', ''))) / 2 AS BIGINT) AS en_count, lpad(source, 20, '.') AS lp, rpad(lang, 5, '*') AS rp,
       regexp_matches(lang, '^[a-zA-Z]+$') AS alpha, regexp_matches(source, '^[a-zA-Z]+$') AS source_alpha, repeat(' ', 3) || lang AS spaced,
       '"' || lang || '"' AS dq, '''' || lang || '''' AS sq, regexp_replace(text, '[0-9]+', '<n>', 'g') AS replaced_all,
       '''' || replace(lang || ',' || source, ',', ''',''') || '''' AS quoted_list, maybe IS NOT NULL AND maybe != '' AS not_empty, maybe IS NULL OR maybe = '' AS empty
       FROM (SELECT *, CASE WHEN lang = 'en' THEN '' WHEN lang = 'de' THEN NULL ELSE lang END AS maybe FROM documents)""",
)
def more_strings(t):
    maybe = F.when(F.col("lang") == "en", "").when(F.col("lang") != "de", F.col("lang"))
    rows = t.documents.withColumn("maybe", maybe)
    return rows.select(
        "doc_id", s.change("text", "th", "TH").alias("changed"), s.ereplace("text", r"([aeiou])\s+", "$1_").alias("ereplaced"),
        s.count_of("text", "en").alias("en_count"), s.lpad("source", 20, ".").alias("lp"), s.rpad("lang", 5, "*").alias("rp"),
        s.is_alpha("lang").alias("alpha"), s.is_alpha("source").alias("source_alpha"), F.concat(s.space(3), "lang").alias("spaced"),
        s.dquote("lang").alias("dq"), s.squote("lang").alias("sq"), s.replace_all("text", "[0-9]+", "<n>").alias("replaced_all"),
        s.quote_sql_list(F.concat_ws(",", "lang", "source")).alias("quoted_list"),
        s.is_not_empty("maybe").alias("not_empty"), s.is_empty("maybe").alias("empty"),
    )


@query(
    "f060_f073_math",
    """SELECT event_id, v IS NULL AS is_null, NOT (event_type = 'view') AS negated, abs(w) AS a, sqrt(value) AS sq, power(w, 2) AS p,
       CAST(ceil(w) AS BIGINT) AS c, CAST(floor(w) AS BIGINT) AS f, CAST(w AS INTEGER) AS i, CAST(w AS BIGINT) AS fx, event_id % 7 AS m, (-event_id) % 7 AS negative_m,
       round(w, 1) AS r, round(ln(value + 1), 10) AS l, round(log10(value + 1), 10) AS l10, true AS random_ok
       FROM (SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v, floor(value * 4) / 4 - 20.25 AS w FROM events)""",
)
def math(t):
    rows = t.events.withColumn("v", F.when(F.col("event_type") != "view", F.col("value"))).withColumn("w", F.floor(F.col("value") * 4) / 4 - 20.25)
    return rows.select(
        "event_id", g.is_null("v").alias("is_null"), g.negate(F.col("event_type") == "view").alias("negated"), n.absolute("w").alias("a"),
        n.square_root("value").alias("sq"), n.power("w", 2).alias("p"), n.ceiling("w").alias("c"), n.floor("w").alias("f"),
        n.integer("w").alias("i"), n.fix("w").alias("fx"), n.modulo("event_id", 7).alias("m"), n.modulo(-F.col("event_id"), 7).alias("negative_m"),
        n.rounded("w", 1).alias("r"), F.round(n.log(F.col("value") + 1), 10).alias("l"), F.round(n.log10(F.col("value") + 1), 10).alias("l10"),
        n.random_int(5, 9).between(5, 9).alias("random_ok"),
    )


@query("f062_numeric_sequence", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def numeric_sequence(t):
    return dedup.sequence(t.events.select("event_id", "ts"), "seq", ["ts", "event_id"]).drop("ts")


@query(
    "f074_f077_data_operations",
    """SELECT user_id, event_id, chr(CAST(65 + user_id % 26 AS INTEGER)) AS letter, chr(CAST(945 + user_id % 20 AS INTEGER)) AS greek, printf('%x', event_id) AS hexed,
       CAST(value AS BIGINT) AS fixed, event_id AS back FROM events""",
)
def data_operations(t):
    return t.events.select(
        "user_id", "event_id", n.char(F.col("user_id") % 26 + 65).alias("letter"), n.char(F.col("user_id") % 20 + 945).alias("greek"),
        n.to_hex("event_id").alias("hexed"), n.fix("value").alias("fixed"), n.from_hex(n.to_hex("event_id")).alias("back"),
    )


@query(
    "f080_context_values",
    "SELECT o_orderkey, 'EU' AS region, '' AS missing, 5 AS level, true AS known FROM orders WHERE o_totalprice > 100000",
)
def context_values(t):
    params = {"region": "EU", "floor": 100000, "level": "5"}
    return t.orders.where(F.col("o_totalprice") > system.param(params, "floor")).select(
        "o_orderkey", system.param(params, "region").alias("region"), system.param(params, "other").alias("missing"),
        system.param(params, "level", "int").alias("level"), system.has_param(params, "region").alias("known"),
    )


@query(
    "f090_f096_other_dialects",
    """SELECT event_id, strftime(ts, '%Y-%m-%d at %H:%M') AS formatted, coalesce(v, -1) AS if_null, coalesce(v, value, 0) AS nvl, coalesce(v, 0) AS is_null_default, true AS now_ok,
       CAST(value AS VARCHAR) AS converted, strptime(strftime(ts, '%d.%m.%Y'), '%d.%m.%Y') AS parsed
       FROM (SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v FROM events)""",
)
def other_dialects(t):
    rows = t.events.withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return rows.select(
        "event_id", d.date_format_percent("ts", "%Y-%m-%d at %H:%i").alias("formatted"), g.ifnull("v", -1.0).alias("if_null"),
        g.nvl("v", F.col("value"), 0.0).alias("nvl"), g.nvl("v", 0.0).alias("is_null_default"),
        (d.now().cast("date") >= d.current_date()).alias("now_ok"), n.convert("string", "value", 103).alias("converted"),
        d.str_to_date(d.format_date("dd.MM.yyyy", "ts"), "%d.%m.%Y").alias("parsed"),
    )


@query(
    "f100_f108_value_methods",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, trim(' ' || p_brand || ' ') AS trimmed, length(p_name) AS len, substring(p_name, 2, 3) AS sub,
       substring(p_name, 6) AS tail, strpos(p_name, 'w') - 1 AS idx, replace(p_name, 'widget', 'part') AS rep, regexp_replace(p_name, '[aeiou]', '', 'g') AS no_vowels,
       regexp_full_match(p_brand, 'Brand#[0-9]') AS whole, regexp_matches(p_brand, '[0-4]') AS part_match, starts_with(p_name, 'small') AS starts, suffix(p_name, 'widget') AS ends,
       contains(p_name, 'd w') AS has, p_name IS NULL OR p_name = '' AS empty, p_type = 'ECONOMY' AS eq, lower(p_type) = 'economy' AS eq_ic FROM part""",
)
def value_methods(t):
    return t.part.select(
        "p_partkey", s.upcase("p_name").alias("up"), s.downcase("p_type").alias("low"), s.trim(F.concat(F.lit(" "), "p_brand", F.lit(" "))).alias("trimmed"),
        s.length("p_name").cast("bigint").alias("len"), s.substring("p_name", 1, 4).alias("sub"), s.substring("p_name", 5).alias("tail"),
        s.index("p_name", "w").cast("bigint").alias("idx"), s.change("p_name", "widget", "part").alias("rep"), s.replace_all("p_name", "[aeiou]", "").alias("no_vowels"),
        s.matches("p_brand", "Brand#[0-9]").alias("whole"), s.search("p_brand", "[0-4]").alias("part_match"), s.starts_with("p_name", "small").alias("starts"),
        s.ends_with("p_name", "widget").alias("ends"), s.contains("p_name", "d w").alias("has"), s.is_empty("p_name").alias("empty"),
        s.equals("p_type", "ECONOMY").alias("eq"), s.equals_ignore_case("p_type", "eCONOMY").alias("eq_ic"),
    )


@query(
    "f109_f114_conversions",
    """SELECT event_id, CAST(event_id AS VARCHAR) AS txt, CAST(value AS INTEGER) AS whole, CAST(CAST(user_id AS VARCHAR) AS INTEGER) AS i, CAST(CAST(event_id AS VARCHAR) AS BIGINT) AS l,
       CAST(CAST(value AS VARCHAR) AS DOUBLE) AS dbl, CAST('1.5' AS FLOAT) AS flt, event_type = 'view' AS b, greatest(v, 50.0) AS hi, least(v, 50.0) AS lo, abs(value - 100) AS ab,
       round(value) AS rd, CAST(user_id AS SMALLINT) AS sm, TRY_CAST(event_type AS INTEGER) AS bad
       FROM (SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v FROM events)""",
)
def conversions(t):
    rows = t.events.withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return rows.select(
        "event_id", n.to_text("event_id").alias("txt"), n.int_value("value").alias("whole"), n.parse_int(n.to_text("user_id")).alias("i"),
        n.parse_long(n.to_text("event_id")).alias("l"), n.parse_double(n.to_text("value")).alias("dbl"), n.parse_float(F.lit("1.5")).alias("flt"),
        n.parse_boolean(F.when(F.col("event_type") == "view", "true").otherwise("false")).alias("b"), n.greatest("v", 50.0).alias("hi"),
        n.least("v", 50.0).alias("lo"), n.absolute(F.col("value") - 100).alias("ab"), n.rounded("value").alias("rd"),
        n.small("user_id").alias("sm"),
        n.parse_int("event_type", strict=False).alias("bad"),
    )


@query(
    "f120_f126_operators",
    """SELECT event_id, v IS NULL AS none, v IS NOT NULL AS some, CASE WHEN value > 100 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band,
       (event_type = 'view' AND value > 50) AS both, (event_type = 'view' OR value > 50) AS either, NOT (value > 50) AS negated, event_type = 'error' AS eq,
       'type=' || event_type || '!' AS joined, 'v=' || CASE WHEN v IS NULL THEN NULL ELSE event_type END AS null_join, CAST(NULL AS VARCHAR) AS nothing, 's' AS lit,
       value + 1 - user_id * 2 / 4 AS arithmetic FROM (SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v FROM events)""",
)
def operators(t):
    rows = t.events.withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    view, large = F.col("event_type") == "view", F.col("value") > 50
    return rows.select(
        "event_id", g.is_null("v").alias("none"), g.is_not_null("v").alias("some"),
        g.choose(F.col("value") > 100, "high", g.choose(F.col("value") > 20, "mid", "low")).alias("band"),
        (view & large).alias("both"), (view | large).alias("either"), (~large).alias("negated"), (F.col("event_type") == "error").alias("eq"),
        s.concat("type=", F.col("event_type"), "!").alias("joined"), s.concat("v=", F.when(F.col("v").isNotNull(), F.col("event_type"))).alias("null_join"),
        F.lit(None).cast("string").alias("nothing"), F.lit("s").alias("lit"), (F.col("value") + 1 - F.col("user_id") * 2 / 4).alias("arithmetic"),
    )
