"""Column expressions shared by the operators. All JVM-side (no Python UDFs)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text date formats tried, in this order, when a string column is tested for dates.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
)

# Fixed value: categorical fill for nulls.
MISSING = "MISSING"


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_time_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def is_missing(name: str, dt: T.DataType) -> Column:
    """Null, or NaN on a floating column: the one notion of 'missing'."""
    c = F.col(name)
    return (c.isNull() | F.isnan(c)) if is_float_type(dt) else c.isNull()


def as_double(name: str, dt: T.DataType) -> Column:
    """Numeric column as double with NaN turned into null."""
    c = F.col(name).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c) if is_float_type(dt) else c


# Shapes every format above starts with / every plain number has. Checking the shape first
# keeps the (exception-driven) parsers away from text that cannot match.
DATE_SHAPE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"


def parse_text_datetime(c: Column) -> Column:
    """Text -> timestamp using the fixed format list; null when nothing parses."""
    return F.when(c.rlike(DATE_SHAPE), F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt in DATE_FORMATS]))


def text_to_double(c: Column) -> Column:
    """Parse-or-null number (ANSI cast would raise); text that says "not a number" is null."""
    v = c.try_cast("double")
    return F.when(c.rlike(NUMBER_SHAPE) & ~F.isnan(v), v)


def round_half_up(c: Column, decimals: int = 4) -> Column:
    """Round half away from zero on the decimal value of a double (what a person reads).

    Going through decimal(38,10) makes the result the same in Spark and DuckDB.
    Values too large for the decimal are returned as is.
    """
    d = c.cast("double")
    return F.when(
        F.abs(d) < F.lit(1e15),
        F.round(d.try_cast("decimal(38,10)"), decimals).cast("double"),
    ).otherwise(d)


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """Wide -> long (id..., column, value); cols must share one type."""
    return df.unpivot(ids, cols, name, value) if cols else df.select(*ids).limit(0)


def stable_hash(*cols: Column, seed: int = 42) -> Column:
    """Deterministic, partitioning-independent 64-bit hash (for repeatable sampling)."""
    return F.xxhash64(F.lit(seed), *cols)
