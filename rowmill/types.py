"""Declared column types of ETL schemas and their Spark types."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import types as T

# Declared type name -> Spark type.
DECLARED = {
    "id_Integer": T.IntegerType(),
    "id_Long": T.LongType(),
    "id_Short": T.ShortType(),
    "id_Byte": T.ByteType(),
    "id_Float": T.FloatType(),
    "id_Double": T.DoubleType(),
    "id_BigDecimal": T.DecimalType(18, 3),
    "id_String": T.StringType(),
    "id_Character": T.StringType(),
    "id_Boolean": T.BooleanType(),
    "id_Date": T.DateType(),
    "id_byte[]": T.BinaryType(),
    "id_Object": T.StringType(),
    "id_List": T.ArrayType(T.StringType()),
    "id_Document": T.StringType(),
}


def spark_type(declared: str, length: int | None = None, precision: int | None = None) -> T.DataType:
    """Spark type of a declared type; an unknown name is text."""
    if declared == "id_BigDecimal" and length and precision:
        return T.DecimalType(length, precision)
    return DECLARED.get(declared, T.StringType())


def declared_schema(columns: Iterable[Mapping[str, Any]]) -> T.StructType:
    """Build a schema from column descriptors.

    A descriptor has ``name`` and ``type`` and may have ``length``, ``precision``, ``nullable``,
    ``key`` and ``comment``. Text length, key flag and comment travel as field metadata.
    """
    fields = []
    for column in columns:
        meta = {k: column[k] for k in ("key", "comment", "length") if column.get(k) is not None}
        kind = spark_type(column.get("type", "id_String"), column.get("length"), column.get("precision"))
        fields.append(T.StructField(column["name"], kind, column.get("nullable", True), meta))
    return T.StructType(fields)
