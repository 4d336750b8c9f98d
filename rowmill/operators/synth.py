"""Synthetic rows from a schema.

Every value is a pure function of (seed, column, row id), so a table is the same for any number of
partitions and after any retry.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.operators.ordered import with_position

# Name parts that mark a join key, share of NULLs, first day, value ranges.
KEY_PARTS = ("id", "key", "sk", "fk", "entityid", "orderid", "code", "number", "num", "no", "ref")
NULL_PERCENT = 5
FIRST_DAY = "2020-01-01"
DAYS = 1501
MAX_INT = 10_000
MAX_CENTS = 9_999_999

# Pick lists.
TITLES = ("Mr.", "Ms.", "Dr.", "Mrs.")
SUFFIXES = ("Jr.", "Sr.", "III", "")
GENDERS = ("M", "F")
DEPARTMENTS = ("Engineering", "Sales", "Marketing", "Finance", "HR", "Operations")
STATUSES = ("Active", "Inactive", "Pending", "Completed", "Cancelled")
TYPES = ("Type_A", "Type_B", "Type_C", "Standard", "Premium")
FLAGS = ("Y", "N")
PRIORITIES = ("High", "Medium", "Low")
REASONS = ("Quality issue", "Cost reduction", "Schedule conflict", "Resource limit", "Client request")
UNITS_OF_MEASURE = ("EA", "KG", "LB", "PC", "BOX", "CTN")
SIZES = ("S", "M", "L", "XL", "XXL")
CITIES = ("New York", "Boston", "Chicago", "Seattle", "Austin")
COUNTRIES = ("US", "UK", "CA", "DE", "IN")
STATES = ("NY", "MA", "IL", "WA", "TX")
FIRST_NAMES = ("Ada", "Bruno", "Chen", "Dana", "Emil", "Farah", "Goran", "Hana")
LAST_NAMES = ("Adams", "Baker", "Costa", "Diaz", "Evans", "Fischer", "Garcia", "Hughes")
STREETS = ("Main St", "Oak Ave", "Park Rd", "Lake Dr", "Hill Ln")
COMPANIES = ("Acme Ltd", "Birch Inc", "Cedar Group", "Delta Works", "Elm Partners")
JOBS = ("Analyst", "Engineer", "Manager", "Clerk", "Director")
COLORS = ("Red", "Green", "Blue", "Black", "White")
TOOLS = ("SQL", "Batch", "Stream", "Import", "Manual")
WORDS = ("alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta", "zeta")


def draw(row_id: Column, column: str, seed: int, salt: str = "") -> Column:
    """A number from 0 to 2^32-1 that depends only on seed, column and row id."""
    text = F.concat_ws("|", F.lit(f"{seed}"), F.lit(f"{column}{salt}"), row_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def pick(values: Sequence[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def is_join_key(name: str, declared_key: bool = False) -> bool:
    return declared_key or any(part in name.lower() for part in KEY_PARTS)


def _digits(number: Column, low: int, high: int) -> Column:
    return (number % (high - low + 1) + low).cast("string")


def _decimal(number: Column, low_cents: int, high_cents: int) -> Column:
    return F.format_string("%.2f", (number % (high_cents - low_cents + 1) + low_cents) / 100.0)


# First rule with a part inside the column name wins; a title is not one in a name that is about a job.
TEXT_RULES = (
    (("firstname", "first_name"), lambda h, i: pick(FIRST_NAMES, h)),
    (("lastname", "last_name"), lambda h, i: pick(LAST_NAMES, h)),
    (("middlename", "middle_name"), lambda h, i: F.left(pick(FIRST_NAMES, h), F.lit(1))),
    (("name",), lambda h, i: F.concat_ws(" ", pick(FIRST_NAMES, h), pick(LAST_NAMES, F.floor(h / 8).cast("bigint")))),
    (("title",), lambda h, i: pick(TITLES, h)),
    (("suffix",), lambda h, i: pick(SUFFIXES, h)),
    (("gender", "sex"), lambda h, i: pick(GENDERS, h)),
    (("email",), lambda h, i: F.concat(F.lit("user"), (i + 1).cast("string"), F.lit("@example.com"))),
    (("phone", "mobile", "fax"), lambda h, i: F.concat(F.lit("555-"), _digits(h, 1000, 9999))),
    (("address",), lambda h, i: F.concat_ws(" ", _digits(h, 1, 999), pick(STREETS, h))),
    (("city",), lambda h, i: pick(CITIES, h)),
    (("state", "province", "region"), lambda h, i: pick(STATES, h)),
    (("zip", "postal"), lambda h, i: _digits(h, 10000, 99999)),
    (("country",), lambda h, i: pick(COUNTRIES, h)),
    (("company", "vendor", "supplier"), lambda h, i: pick(COMPANIES, h)),
    (("department", "dept"), lambda h, i: pick(DEPARTMENTS, h)),
    (("jobtitle", "job_title", "position"), lambda h, i: pick(JOBS, h)),
    (("cost", "price", "amount", "total"), lambda h, i: _decimal(h, 100, 5_000_000)),
    (("rate",), lambda h, i: _decimal(h, 1, 10_000)),
    (("qty", "quantity", "count"), lambda h, i: _digits(h, 1, 500)),
    (("weight", "mass"), lambda h, i: _decimal(h, 10, 100_000)),
    (("hrs", "hours"), lambda h, i: _decimal(h, 50, 4_000)),
    (("status",), lambda h, i: pick(STATUSES, h)),
    (("type", "category"), lambda h, i: pick(TYPES, h)),
    (("flag", "is_", "has_"), lambda h, i: pick(FLAGS, h)),
    (("priority",), lambda h, i: pick(PRIORITIES, h)),
    (("description", "comment", "note", "remark"), lambda h, i: F.concat(F.lit("Description for item "), (i + 1).cast("string"))),
    (("reason",), lambda h, i: pick(REASONS, h)),
    (("url", "website"), lambda h, i: F.concat(F.lit("https://example.com/"), (i + 1).cast("string"))),
    (("date",), lambda h, i: F.date_format(_day(h), "yyyy-MM-dd")),
    (("time",), lambda h, i: F.format_string("%02d:%02d:%02d", h % 24, F.floor(h / 24) % 60, F.floor(h / 1440) % 60)),
    (("measure", "uom", "unit"), lambda h, i: pick(UNITS_OF_MEASURE, h)),
    (("color", "colour"), lambda h, i: pick(COLORS, h)),
    (("size",), lambda h, i: pick(SIZES, h)),
    (("tool", "system", "source"), lambda h, i: pick(TOOLS, h)),
    (("version",), lambda h, i: F.concat(_digits(h, 1, 10), F.lit("."), _digits(F.floor(h / 10).cast("bigint"), 0, 9))),
    (("user", "login", "created_by", "modified_by"), lambda h, i: F.concat(F.lit("user"), _digits(h, 1, 999))),
)


def _day(number: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (number % DAYS).cast("int"))


def _text(name: str, number: Column, row: Column) -> Column:
    lowered = name.lower()
    for parts, rule in TEXT_RULES:
        if any(p in lowered for p in parts) and not (parts == ("title",) and "job" in lowered):
            return rule(number, row)
    return F.concat_ws("_", pick(WORDS, number), (row + 1).cast("string"))


def _key(kind: T.DataType, number: Column, row: Column) -> Column:
    if isinstance(kind, T.DateType):
        return F.date_add(F.lit(FIRST_DAY).cast("date"), row.cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_add(F.lit(FIRST_DAY).cast("date"), row.cast("int")).cast(kind)
    if isinstance(kind, T.BooleanType):
        return number % 2 == 0
    return (row % _LARGEST.get(type(kind), 1 << 62) + 1).cast(kind) if not isinstance(kind, T.DecimalType) else _whole(kind, row)


# Largest key of the small number types; later rows begin again at 1.
_LARGEST = {T.ByteType: 127, T.ShortType: 32_767, T.IntegerType: 2_147_483_647}


def _whole(kind: T.DecimalType, row: Column) -> Column:
    """Row numbers from 1 inside a decimal's whole digits, or of its last place where it has no whole digits."""
    digits = kind.precision - kind.scale
    if digits < 1:
        return ((row % (10 ** min(kind.precision, 18) - 1) + 1).cast("decimal(38,0)") / F.lit(10**kind.scale).cast("decimal(38,0)")).cast(kind)
    return (row % (10 ** min(digits, 18) - 1) + 1).cast(kind)


def _fraction(kind: T.DataType, number: Column) -> Column:
    """A number with two places, inside the precision and scale of a decimal."""
    if not isinstance(kind, T.DecimalType):
        return ((number % MAX_CENTS + 1) / 100.0).cast(kind)
    places = min(kind.scale, 2)
    largest = min(10 ** min(kind.precision - kind.scale + places, 18) - 1, MAX_CENTS // 10 ** (2 - places))
    return ((number % max(largest, 1) + 1).cast("decimal(20,0)") / F.lit(10**places).cast("decimal(20,0)")).cast(kind)


def column_value(field: T.StructField, row: Column, seed: int = 42) -> Column:
    """The value of one column for 0-based row number ``row``."""
    kind, number = field.dataType, draw(row, field.name, seed)
    key = bool(field.metadata.get("key"))
    if isinstance(kind, T.BinaryType):
        return F.lit(None).cast(kind)
    if is_join_key(field.name, key):
        value = _key(kind, number, row)
    elif isinstance(kind, T.IntegralType):
        value = (number % (100 if isinstance(kind, T.ByteType) else MAX_INT) + 1).cast(kind)
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        value = _fraction(kind, number)
    elif isinstance(kind, T.BooleanType):
        value = number % 2 == 0
    elif isinstance(kind, T.DateType):
        value = _day(number)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        hours = F.floor(number / DAYS).cast("bigint") % 24
        value = F.timestamp_add("HOUR", hours.cast("int"), _day(number).cast(kind)).cast(kind)
    else:
        value = _text(field.name, number, row).cast(kind)
    if field.nullable and not key:
        return F.when(draw(row, field.name, seed, "?") % 100 >= NULL_PERCENT, value)
    return value


def synth(rows: DataFrame, schema: T.StructType, row: Column, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """One synthetic row per row of ``rows``; ``row`` is its 0-based number."""
    schema = unique_columns(schema)
    return rows.select(*keep, *[column_value(f, row, seed).alias(f.name) for f in schema.fields])


def synth_table(spark: SparkSession, schema: T.StructType, n: int, seed: int = 42) -> DataFrame:
    """``n`` synthetic rows."""
    return synth(spark.range(n), schema, F.col("id"), seed)


def unique_columns(schema: T.StructType) -> T.StructType:
    """Schema without repeated names, case ignored; the first stays."""
    seen: dict[str, T.StructField] = {}
    for field in schema.fields:
        seen.setdefault(field.name.lower(), field)
    return T.StructType(list(seen.values()))


def reconcile(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """Add columns that are used elsewhere but missing here, as NULL text."""
    have = {c.lower() for c in df.columns}
    missing = {}
    for name in needed:
        if name.lower() not in have:
            have.add(name.lower())
            missing[name] = F.lit(None).cast("string")
    return df.withColumns(missing) if missing else df


def patch_foreign_key(
    parent: DataFrame, parent_column: str, child: DataFrame, child_column: str, order: Sequence, pool: int | None = None
) -> DataFrame:
    """Give a child column values of its parent column when the two have none in common.

    Child rows in ``order`` take all distinct parent values in turn, or the first ``pool`` of them. Compares, counts and
    sorts when it is called.
    """
    kind = child.schema[child_column].dataType
    values = parent.select(F.col(parent_column).alias("v")).where(F.col(parent_column).isNotNull()).distinct()
    # Both sides are reduced to distinct values, so a frequent value is one row here.
    used = child.select(F.col(child_column).cast("string").alias("v")).distinct()
    if not values.select(F.col("v").cast("string").alias("v")).join(used, "v", "left_semi").isEmpty():
        return child
    numbered = with_position(child, order, "_n", start=0)
    if pool is not None:
        # At most ``pool`` values, so the list is a constant of known size.
        chosen = values.orderBy("v").limit(pool).agg(F.array_sort(F.collect_list("v")).alias("p")).scalar()
        size = F.size(chosen)
        new = F.when(size > 0, F.get(chosen, (F.col("_n") % F.greatest(size, F.lit(1))).cast("int")))
        patched = numbered.withColumn("_new", new)
    else:
        ranked = with_position(values, ["v"], "_i", start=0)
        size = F.greatest(values.agg(F.count("*").alias("n")).scalar(), F.lit(1))
        patched = numbered.withColumn("_slot", F.col("_n") % size).join(
            ranked.select(F.col("v").alias("_new"), F.col("_i").alias("_slot")), "_slot", "left"
        )
    value = F.coalesce(F.col("_new").cast(kind), F.col(child_column))
    return patched.withColumn(child_column, value).select(*child.columns)
