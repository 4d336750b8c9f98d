"""Sources, sinks, session helpers."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill import scratch_path, session
from rowmill.sinks import files as out
from rowmill.sinks import tables as sinks
from rowmill.sources import files as src
from rowmill.sources import jdbc, tables


def test_jdbc_options_for_a_split_read():
    got = jdbc.read_options("jdbc:x:y", query="SELECT 1 a", partition_column="a", lower=0, upper=9, partitions=3)
    assert got["dbtable"] == "(SELECT 1 a) q" and "query" not in got
    assert (got["partitionColumn"], got["lowerBound"], got["upperBound"], got["numPartitions"]) == ("a", "0", "9", "3")
    assert jdbc.read_options("jdbc:x:y", query="SELECT 1")["query"] == "SELECT 1"
    with pytest.raises(ValueError):
        jdbc.read_options("jdbc:x:y", table="t", query="q")
    with pytest.raises(ValueError):
        jdbc.read_options("jdbc:x:y", table="t", partition_column="a")
    assert jdbc.write_options("jdbc:x:y", "t", truncate=True, partitions=4)["truncate"] == "true"


def test_catalogue(spark, sf):
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("cat_nation")
    found = {r["name"]: r["columns"] for r in tables.list_sources(spark).collect()}
    assert found["cat_nation"] == 3
    columns = [(r["column"], r["type"], r["ordinal"]) for r in tables.list_columns(spark, "cat_nation").collect()]
    assert columns == [("n_nationkey", "int", 0), ("n_name", "string", 1), ("n_regionkey", "int", 2)]


def test_delimited_bad_line_fails_or_is_kept(spark):
    path = scratch_path(spark, "csv")
    out.write_full_row(spark.createDataFrame([("a;1",), ("b;x",)], "l string"), path, "l")
    with pytest.raises(Exception, match="Malformed|MALFORMED|FAILED_READ_FILE"):
        src.read_delimited(spark, path, "k string, n int", sep=";", header=False).collect()
    kept = src.read_delimited(spark, path, "k string, n int", sep=";", header=False, keep_corrupt=True).collect()
    assert sorted((r["k"], r["n"], r[src.CORRUPT]) for r in kept) == [("a", 1, None), ("b", None, "b;x")]


def test_delimited_round_trip_of_awkward_text(spark):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    path = scratch_path(spark, "csv")
    out.write_delimited(df, path)
    got = src.read_delimited(spark, path, "id int, t string", multiline=True)
    assert sorted(tuple(r) for r in got.collect()) == rows


def foreign_csv(folder, rows, newline="\n", header=True, end=True):
    """A file as other programs write it: values quoted where needed, line ends as they are."""
    cell = lambda v: "" if v is None else f'"{v.replace(chr(34), chr(34) * 2)}"' if any(c in v for c in '",\r\n') or v == "" else v
    lines = (["id,t,u"] if header else []) + [f"{i},{cell(a)},{cell(b)}" for i, a, b in rows]
    with open(f"{folder}/a.csv", "w", encoding="utf-8", newline="") as f:
        f.write(newline.join(lines) + (newline if end else ""))
    return str(folder)


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: small_splits(spark, size)
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["7", "64", "1000", "10m"])
def test_quoted_line_ends_in_parts(spark, tmp_path, splits, size, newline):
    """One file in many splits: splits that start or end inside values, records over several splits, blank lines in values."""
    rng = random.Random(4)
    texts = ["plain", None, "two\nlines", 'say "hi",\n\n"yes"', "\n", '"', '""\n"', "long\n" * 60, "é日本\n", "x" * 150, "\n,\n"]
    rows = [(i, rng.choice(texts), rng.choice(texts)) for i in range(40 if size == "7" else 120)]
    path = foreign_csv(tmp_path, rows, newline, end=size != "64")
    whole = spark.read.csv(path, schema="id int, t string, u string", header=True, escape='"', multiLine=True, mode="FAILFAST")
    splits(size)
    got = src.read_delimited(spark, path, "id int, t string, u string", quoted_lines=True)
    if size != "10m":
        assert src.read_records(spark, path).rdd.getNumPartitions() > 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_quoted_line_ends_over_arrow_batches(spark, tmp_path, splits):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(i, "a\nb\nc", f"{i}\n") for i in range(60)]
    path = foreign_csv(tmp_path, rows, header=False)
    splits("300")
    try:
        for n in ("1", "3", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = src.read_delimited(spark, path, "id int, t string, u string", header=False, quoted_lines=True)
            assert sorted(map(tuple, got.collect())) == rows
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_quoted_line_ends_odd_files(spark, tmp_path, splits):
    splits("16")
    schema = "id int, t string, u string"
    (tmp_path / "b").mkdir()
    path = foreign_csv(tmp_path / "b", [])
    assert src.read_delimited(spark, path, schema, quoted_lines=True).collect() == []
    (tmp_path / "b" / "c.csv").write_text('\ufeffid,"t\n,t",u\n\n1,"x\\ny",z\n\n', encoding="utf-8")
    (tmp_path / "b" / "d.csv").write_text("")
    got = src.read_delimited(spark, path, schema, quoted_lines=True)
    assert [tuple(r) for r in got.collect()] == [(1, "x\\ny", "z")]
    (tmp_path / "b" / "e.csv").write_text('id,t,u\n1,"open,2\n')
    with pytest.raises(ValueError, match="unbalanced"):
        src.read_delimited(spark, path, schema, quoted_lines=True)
    with pytest.raises(ValueError):
        src.read_delimited(spark, path, quoted_lines=True)


def test_quoted_line_ends_backslash_and_rejects(spark, tmp_path, splits):
    splits("20")
    (tmp_path / "x.csv").write_text('1;"a \\"q\\"\nb"\nbad;"c\nd"\n3;"e"\n')
    got = src.read_delimited(spark, str(tmp_path), "id int, t string", sep=";", header=False, escape="\\", quoted_lines=True, keep_corrupt=True)
    rows = {r.t: (r.id, r[src.CORRUPT]) for r in got.collect()}
    assert rows == {'a "q"\nb': (1, None), "c\nd": (None, 'bad;"c\nd"'), "e": (3, None)}
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        src.read_delimited(spark, str(tmp_path), "id int, t string", sep=";", header=False, escape="\\", quoted_lines=True).collect()


def test_inferred_types(spark):
    path = scratch_path(spark, "csv")
    out.write_delimited(spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string"), path)
    assert [f.dataType.typeName() for f in src.read_delimited(spark, path).schema.fields] == ["integer", "double", "string"]


def test_ldif_folded_lines_and_repeated_attributes(spark):
    path = scratch_path(spark, "ldif")
    text = "dn: cn=A\ncn: A\nmail: x@y\nmail: z@\n y\n# note\n\ndn: cn=B\ncn: B\n"
    out.write_full_row(spark.createDataFrame([(text,)], "t string"), path, "t")
    got = {r["dn"]: r["attributes"] for r in src.read_ldif(spark, path).collect()}
    assert got == {"cn=A": {"cn": ["A"], "mail": ["x@y", "z@y"]}, "cn=B": {"cn": ["B"]}}


def test_positional_nulls_and_padding(spark):
    path = scratch_path(spark, "fixed")
    out.write_positional(spark.createDataFrame([(7, None), (12, "ab")], "n int, s string"), path, [("n", 4), ("s", 3)], right=["n"], pad={"n": "0"})
    assert sorted(r["line"] for r in src.read_full_row(spark, path).collect()) == ["0007   ", "0012ab "]


def test_partitioned_parquet_prunes(spark, sf):
    path = scratch_path(spark, "parquet")
    out.write_parquet(spark.read.parquet(f"{sf}/lineitem.parquet"), path, ["l_returnflag"])
    plan = src.read_parquet(spark, path).where("l_returnflag = 'R'").select("l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(l_returnflag" in plan and "ReadSchema: struct<l_tax:double>" in plan


def test_bucketed_tables_join_without_a_shuffle(spark, sf):
    orders, items = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    a = sinks.materialize_as(orders, "b_orders", "table", path=scratch_path(spark, "t"), bucket_by=(4, "o_orderkey"))
    b = sinks.materialize_as(items, "b_items", "table", path=scratch_path(spark, "t"), bucket_by=(4, "l_orderkey"))
    joined = a.hint("merge").join(b, a.o_orderkey == b.l_orderkey).select("o_orderkey", "l_tax")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == items.count()


def test_ddl(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    sinks.create_table(spark, "ddl_t", schema, path=scratch_path(spark, "t"))
    sinks.elt_output(spark.createDataFrame([("x", 1)], "b string, a int"), "ddl_t")
    assert [tuple(r) for r in spark.table("ddl_t").collect()] == [(1, "x")]
    sinks.elt_output(spark.createDataFrame([(2, "y")], "a int, b string"), "ddl_t", overwrite=True)
    assert [tuple(r) for r in spark.table("ddl_t").collect()] == [(2, "y")]
    sinks.drop_table(spark, "ddl_t")
    assert not spark.catalog.tableExists("ddl_t")


def test_unescape_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_order int, _mine int, name int")
    assert tables.unescape_columns(df, ["order", "name"]).columns == ["order", "_mine", "name"]


def test_query_parameters(spark):
    got = tables.read_query(spark, "SELECT id FROM {rows} WHERE id > :low", {"low": 2}, rows=spark.range(5))
    assert sorted(r["id"] for r in got.collect()) == [3, 4]


def test_shared_folder_follows_the_session(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf(None)

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    set_, unset = Session(), Session()
    set_.conf, unset.conf = Conf("s3a://bucket/ckpt/"), Conf(None)
    assert session.shared_dir(set_) == "s3a://bucket/ckpt"
    with pytest.raises(RuntimeError):
        session.shared_dir(unset)


@pytest.mark.parametrize("end,newline", [("\n", "\n"), ("\r\n", "\n"), ("\r\n", "\r\n")])
def test_ldif_line_ends_and_base64(spark, tmp_path, end, newline):
    import base64

    text = ["# comment", "dn: cn=a", "cn: a", "mail: x@y", "mail: z@y", "note: folded", " text", "", "dn:: " + base64.b64encode("cn=é".encode()).decode(), "cn: b:c", "", ""]
    (tmp_path / "f.ldif").write_bytes(end.join(text).encode())
    got = {r.dn: r.attributes for r in src.read_ldif(spark, str(tmp_path / "f.ldif"), newline).collect()}
    assert got == {"cn=a": {"cn": ["a"], "mail": ["x@y", "z@y"], "note": ["foldedtext"]}, "cn=é": {"cn": ["b:c"]}}


def test_ldif_files_are_read_in_parts_whatever_their_line_ends(spark, tmp_path):
    entry = lambda i, end: f"dn: cn={i}{end}cn: {i}{end}{end}"
    (tmp_path / "crlf").mkdir()
    (tmp_path / "crlf" / "a.ldif").write_bytes("".join(entry(i, "\r\n") for i in range(2000)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = src.read_ldif(spark, str(tmp_path / "crlf"))
        assert df.select(F.spark_partition_id()).distinct().count() > 1
        assert {(r.dn, r.attributes["cn"][0]) for r in df.collect()} == {(f"cn={i}", str(i)) for i in range(2000)} and df.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "crlf" / "b c.ldif").write_bytes("".join(entry(i, "\n") for i in range(2000, 2010)).encode())
    (tmp_path / "crlf" / "one.ldif").write_bytes(b"dn: cn=2010\r\ncn: 2010\r\n")
    (tmp_path / "crlf" / "mixed.ldif").write_bytes((entry(2011, "\n") + entry(2012, "\r\n") + entry(2013, "\r\n") + entry(2014, "\n")).encode())
    got = src.read_ldif(spark, str(tmp_path / "crlf")).collect()
    assert sorted((int(r.dn[3:]), r.attributes["cn"]) for r in got) == [(i, [str(i)]) for i in range(2015)]


def test_generate_rows_per(spark, monkeypatch):
    monkeypatch.setattr(tables, "_BLOCK", 3)
    df = spark.createDataFrame([("a", 7), ("b", 0), ("c", None), ("d", 3), ("e", -2)], "k string, n int")
    out = tables.generate_rows_per(df, "n", {"i": "id * 2"}).select("k", "i").collect()
    assert sorted((r.k, r.i) for r in out) == [("a", 2 * i) for i in range(7)] + [("d", 2 * i) for i in range(3)]


def test_delimited_lines_can_be_split(spark, tmp_path):
    rows = [(1, "a\nb\r\nc"), (2, "back\\slash \\n \\\\n\\b\\"), (3, None), (4, "plain"), (5, 'q"uote,\n')]
    out.write_delimited(spark.createDataFrame(rows, "k int, v string"), str(tmp_path / "f"), code_lines=True)
    assert len(spark.read.text(str(tmp_path / "f")).where("value != 'k,v'").collect()) == len(rows)
    back = src.read_delimited(spark, str(tmp_path / "f"), "k int, v string", code_lines=True)
    assert sorted((r.k, r.v) for r in back.collect()) == rows
