"""Numbers and conversions between numbers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions import ColumnLike, arg, col


def absolute(x: ColumnLike) -> Column:
    return F.abs(col(x))


def square_root(x: ColumnLike) -> Column:
    return F.sqrt(col(x))


def power(x: ColumnLike, y: float | Column) -> Column:
    return F.pow(col(x), arg(y))


def ceiling(x: ColumnLike) -> Column:
    return F.ceil(col(x))


def floor(x: ColumnLike) -> Column:
    return F.floor(col(x))


def _whole(x: ColumnLike, kind: str, mode: str, strict: bool = True) -> Column:
    if mode not in ("round", "truncate"):
        raise ValueError("mode is round or truncate")
    value = F.rint(col(x)) if mode == "round" else col(x)
    return value.cast(kind) if strict else value.try_cast(kind)


def integer(x: ColumnLike, mode: str = "round") -> Column:
    """Whole number; rounds halves to even, or cuts the fraction with ``mode="truncate"``."""
    return _whole(x, "int", mode)


def fix(x: ColumnLike, mode: str = "round") -> Column:
    """As ``integer``, for large numbers."""
    return _whole(x, "bigint", mode)


def modulo(x: ColumnLike, y: float | Column) -> Column:
    """Remainder with the sign of the dividend."""
    return col(x) % arg(y)


def rounded(x: ColumnLike, digits: int = 0) -> Column:
    """Halves round away from zero."""
    return F.round(col(x), digits)


def log(x: ColumnLike) -> Column:
    """Natural logarithm."""
    return F.ln(col(x))


def log10(x: ColumnLike) -> Column:
    return F.log10(col(x))


def greatest(x: ColumnLike, y: float | Column) -> Column:
    """The larger value; NULL is skipped."""
    return F.greatest(col(x), arg(y))


def least(x: ColumnLike, y: float | Column) -> Column:
    """The smaller value; NULL is skipped."""
    return F.least(col(x), arg(y))


def random_int(low: int = 0, high: int = 2147483646, seed: int | None = None) -> Column:
    """Uniform whole number from ``low`` to ``high``, both included."""
    return F.floor(F.rand(seed) * (high - low + 1) + low).cast("int")


def char(code: ColumnLike) -> Column:
    """Character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(col(code).cast("bigint")), 8, "0")), "UTF-32")


def to_hex(x: ColumnLike) -> Column:
    """Lower-case hexadecimal text."""
    return F.lower(F.hex(col(x).cast("bigint")))


def from_hex(text: ColumnLike) -> Column:
    """Number of a hexadecimal text; NULL when it is not one or is larger than a BIGINT."""
    digits = F.regexp_replace(col(text), r"^0+(?=.)", "")
    return F.when(digits.rlike(r"^[0-9a-fA-F]{1,16}\z"), F.conv(digits, 16, 10).try_cast("bigint"))


# Text to values. The strict forms fail on text that is not a value, the try forms give NULL.
def to_text(x: ColumnLike) -> Column:
    return col(x).cast("string")


def parse_int(x: ColumnLike, strict: bool = True) -> Column:
    return col(x).cast("int") if strict else col(x).try_cast("int")


def parse_long(x: ColumnLike, strict: bool = True) -> Column:
    return col(x).cast("bigint") if strict else col(x).try_cast("bigint")


def parse_double(x: ColumnLike, strict: bool = True) -> Column:
    return col(x).cast("double") if strict else col(x).try_cast("double")


def parse_float(x: ColumnLike, strict: bool = True) -> Column:
    return col(x).cast("float") if strict else col(x).try_cast("float")


def parse_boolean(x: ColumnLike, strict: bool = True) -> Column:
    return col(x).cast("boolean") if strict else col(x).try_cast("boolean")


def int_value(x: ColumnLike, mode: str = "round") -> Column:
    """Integer of a number, as ``integer``."""
    return _whole(x, "int", mode)


def small(x: ColumnLike, mode: str = "round", strict: bool = True) -> Column:
    """Small integer of a number, as ``integer``. One that does not fit fails, or is NULL when not ``strict``."""
    return _whole(x, "smallint", mode, strict)


def convert(kind: str, x: ColumnLike, style: int | None = None) -> Column:
    """Cast to a named type; the style has no effect."""
    return col(x).cast(kind)
