"""File sources. Paths may be local, ``s3a://``, ``gs://`` or ``abfss://`` and may be globs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.sinks.files import LINE_CODES
from rowmill.sources.records import read_records

CORRUPT = "_corrupt_record"


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True,
    quote: str = '"', escape: str = '"', encoding: str = "UTF-8", keep_corrupt: bool = False, multiline: bool = False,
    code_lines: bool = False, quoted_lines: bool = False,
) -> DataFrame:
    """Delimited text. Without a schema the types are inferred, which costs one more pass.

    Line ends inside values need one of three: ``quoted_lines`` for files of any writer that quotes such values, read in
    parts (see ``records``; needs a schema and UTF-8); ``code_lines``, which restores what ``write_delimited`` wrote with it;
    ``multiline``, which makes each file one task and also takes quotes inside unquoted values.

    ``keep_corrupt`` adds ``_corrupt_record`` with the text of lines that do not fit the schema;
    without it such a line fails the read.
    """
    reader = (
        spark.read.option("sep", sep).option("header", header).option("quote", quote).option("escape", escape)
        .option("encoding", encoding).option("multiLine", multiline)
    )
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if quoted_lines:
        if schema is None or encoding.upper().replace("-", "") != "UTF8":
            raise ValueError("quoted_lines needs a schema and UTF-8")
        df = _parsed_records(read_records(spark, path, quote, escape), schema, sep, header, quote, escape, keep_corrupt)
    elif schema is None:
        df = reader.option("inferSchema", True).csv(path)
    elif keep_corrupt:
        wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(wide).csv(path)
    else:
        df = reader.option("mode", "FAILFAST").schema(schema).csv(path)
    return whole_lines(df) if code_lines else df


def _parsed_records(
    records: DataFrame, schema: T.StructType, sep: str, header: bool, quote: str, escape: str, keep_corrupt: bool
) -> DataFrame:
    options = {"sep": sep, "quote": quote, "escape": escape, "multiLine": "true", "mode": "PERMISSIVE" if keep_corrupt else "FAILFAST"}
    fields = list(schema.fields)
    if keep_corrupt:
        options["columnNameOfCorruptRecord"] = CORRUPT
        fields.append(T.StructField(CORRUPT, T.StringType()))
    rows = records.where(~F.col("first")) if header else records.where("record != ''")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    # An array of one, so that a record is parsed once for all columns.
    return rows.select(F.inline(F.array(F.from_csv("record", kinds, options))))


def whole_lines(df: DataFrame) -> DataFrame:
    """Undo ``one_line`` of the sinks: the backslash comes back last."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name != CORRUPT]
    plain = {c: reduce(lambda v, p: F.replace(v, F.lit(p[1]), F.lit(p[0])), reversed(LINE_CODES), F.col(f"`{c}`")) for c in text}
    return df.withColumns(plain) if plain else df


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    """JSON records, one per line or (``multiline``) one document per file."""
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One row per ``row_tag`` element."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_full_row(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """One column with each line."""
    return spark.read.text(path).withColumnRenamed("value", name)


def read_positional(
    spark: SparkSession, path: str, fields: Sequence[tuple[str, int, int]], types: Mapping[str, str] | None = None,
    trim: bool = True,
) -> DataFrame:
    """Fixed-width lines; fields are ``(name, start, length)`` with start from 0."""
    types = types or {}
    out = []
    for name, start, length in fields:
        part = F.substring("value", start + 1, length)
        part = F.trim(part) if trim else part
        out.append((part.cast(types[name]) if name in types else part).alias(name))
    return spark.read.text(path).select(*out)


def read_regex(spark: SparkSession, path: str, pattern: str, names: Sequence[str], keep_unmatched: bool = False) -> DataFrame:
    """Lines parsed by the capture groups of a pattern."""
    lines = spark.read.text(path)
    hit = F.col("value").rlike(pattern)
    groups = [F.when(hit, F.regexp_extract("value", pattern, i + 1)).alias(n) for i, n in enumerate(names)]
    return (lines if keep_unmatched else lines.where(hit)).select(*groups)


def _blank_crlf(spark: SparkSession, path: str) -> dict[str, bool]:
    """For each file, whether most of its blank lines end in CRLF. Reads the files once, line by line."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    crlf = F.count_if(F.col("value") == "\r") > F.count_if(F.col("value") == "")
    return {unquote(r.file): r.crlf for r in lines.groupBy("file").agg(crlf.alias("crlf")).collect()}


def read_ldif(spark: SparkSession, path: str, newline: str | None = None) -> DataFrame:
    """LDIF entries, separated by blank lines, as ``(dn, attributes)`` with all values of each attribute.

    An entry is one record, so only its own lines are gathered. Lines may end in LF or CRLF, in one file or
    several. Folded lines are joined first; values after ``::`` are decoded from base64 as UTF-8.

    Files are cut at the blank lines that are more frequent in each of them, so that large ones are read in parts,
    whatever ends their lines; ``newline`` names the line end of all files instead and saves the pass that finds it.
    """
    cut = lambda sep, paths: spark.read.option("lineSep", sep).text(paths)
    if newline is not None:
        parts = cut(newline * 2, path)
    else:
        found = _blank_crlf(spark, path)
        crlf = [f for f, yes in found.items() if yes]
        if not crlf:
            parts = cut("\n\n", path)
        elif len(crlf) == len(found):
            parts = cut("\n\r\n", path)
        else:
            parts = cut("\n\r\n", crlf).unionByName(cut("\n\n", [f for f, yes in found.items() if not yes]))
    # What is left are blank lines of the other kind.
    records = parts.select(F.explode(F.split(F.regexp_replace("value", r"\r\z", ""), r"\r?\n\r?\n")).alias("value"))
    records = records.where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    unfolded = F.regexp_replace("value", "\r?\n ", "")
    lines = F.filter(F.split(unfolded, "\r?\n"), lambda s: s.contains(":") & ~s.startswith("#"))
    pairs = F.transform(
        lines,
        lambda s: F.struct(
            F.trim(F.substring_index(s, ":", 1)).alias("name"),
            F.when(s.rlike("^[^:]*::"), F.decode(F.unbase64(F.trim(F.regexp_replace(s, r"^[^:]*::", ""))), "UTF-8"))
            .otherwise(F.trim(F.regexp_replace(s, r"^[^:]*:", "")))
            .alias("value"),
        ),
    )
    entries = records.select(pairs.alias("_pairs"))
    names = F.array_distinct(F.transform("_pairs", lambda p: p["name"]))
    values = F.map_from_entries(
        F.transform(
            F.filter(names, lambda n: n != "dn"),
            lambda n: F.struct(n, F.transform(F.filter("_pairs", lambda p: p["name"] == n), lambda p: p["value"])),
        )
    )
    dn = F.get(F.transform(F.filter("_pairs", lambda p: p["name"] == "dn"), lambda p: p["value"]), F.lit(0))
    return entries.select(dn.alias("dn"), values.alias("attributes"))


def read_files(spark: SparkSession, glob: str, file_format: str = "parquet", name: str = "file_name", **options) -> DataFrame:
    """Rows of all files that match, with the name of the file each row came from."""
    df = spark.read.format(file_format).options(**options).load(glob)
    return df.withColumn(name, F.element_at(F.split(F.input_file_name(), "/"), -1))


READERS = {"parquet": read_parquet, "csv": read_delimited, "delimited": read_delimited, "json": read_json, "text": read_full_row}


def read_lake_path(spark: SparkSession, uri: str, file_format: str, **options) -> DataFrame:
    """Files below an object-store or data-lake address, by format."""
    return READERS[file_format](spark, uri, **options)


def load_as_table(
    spark: SparkSession, path: str, file_format: str, name: str, location: str | None = None, **options
) -> int:
    """Create or replace a table from files and give its row count."""
    writer = READERS[file_format](spark, path, **options).write.mode("overwrite")
    (writer.option("path", location) if location else writer).saveAsTable(name)
    return spark.table(name).count()
