"""From source columns to cells and dimension values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Categorical, Continuous

#: Text that counts as a number: no blanks, suffixes or hexadecimal forms, which Spark's cast would take.
NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|infinity|nan)$"
DATE_PREFIX = r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}"
UNKNOWN = -1


def to_number(col: Column, kind: T.DataType) -> Column:
    """The value as a double, or null."""
    if isinstance(kind, T.StringType):
        return F.when(F.lower(col).rlike(NUMBER), col.try_cast("double"))
    if isinstance(kind, T.NumericType):
        return col.cast("double")
    return F.lit(None).cast("double")


def bin_index(value: Column, kind: Continuous) -> Column:
    """The bin of a double; what lies outside the range goes to the edge bins, NaN to the first."""
    if kind.width <= 0:
        return F.lit(None).cast("int")
    raw = F.floor((value - F.lit(kind.low)) / F.lit(kind.width))
    # greatest and least leave nulls out, so a null has to be kept apart
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(kind.bins - 1), raw))).cast("int")


def category_text(col: Column, kind: T.DataType) -> Column:
    """Strings, integers and booleans as text; other types, and nulls, are the text "unknown"."""
    if isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType)):
        return F.coalesce(col.cast("string"), F.lit("unknown"))
    return F.lit("unknown")


def category_index(text: Column, kind: Categorical) -> Column:
    """The category's index, else UNKNOWN where that is allowed, else null."""
    at = F.array_position(F.array(*(F.lit(c) for c in kind.categories)), text).cast("int") - 1
    return at if kind.allow_unknown else F.when(at >= 0, at)


def cell(col: Column, source: T.DataType, kind: Continuous | Categorical) -> Column:
    if isinstance(kind, Continuous):
        return bin_index(to_number(col, source), kind)
    return category_index(category_text(col, source), kind)


def timestamp(col: Column, source: T.DataType) -> Column:
    if isinstance(source, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp")
    text = col.cast("string")
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def dimension_value(col: Column, source: T.DataType, granularity: str | None) -> Column:
    """A dimension's text; dates are cut to the granularity, and what is no date stays as it is. Nested values are null."""
    if isinstance(source, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast("string")
    text = col.cast("string")
    cut = cut_time(timestamp(col, source), granularity)
    return text if cut is None else F.coalesce(cut, text)


def cut_time(ts: Column, granularity: str | None) -> Column | None:
    formats = {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}
    if granularity in formats:
        return F.date_format(ts, formats[granularity])
    if granularity == "weekly":
        return F.when(ts.isNotNull(), F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts)))
    return None
