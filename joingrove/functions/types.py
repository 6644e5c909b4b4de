"""Type families: what may be joined with what, and what may be a feature."""

from __future__ import annotations

from pyspark.sql import types as T

from joingrove.functions.naming import quote

INTEGRAL, FRACTIONAL, STRING, BOOLEAN, TIMESTAMP, OTHER = (
    "integral", "fractional", "string", "boolean", "timestamp", "other")
NUMERIC = (INTEGRAL, FRACTIONAL)


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGRAL
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FRACTIONAL
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIMESTAMP
    return OTHER


def families(schema: T.StructType) -> dict[str, str]:
    return {f.name: family(f.dataType) for f in schema.fields}


def number_sql(name: str, dtype: T.DataType) -> str:
    """SQL text for a numeric, boolean or time column as a double.

    NaN counts as null. A timestamp without zone is read off its own calendar
    fields, so its seconds since 1970 do not depend on the session time zone.
    """
    col, kind = quote(name), family(dtype)
    if isinstance(dtype, T.DoubleType):
        return f"nanvl({col}, cast(null AS double))"
    if isinstance(dtype, T.TimestampType):
        return f"unix_micros({col}) / 1e6D"
    if kind == TIMESTAMP:
        days = f"unix_date(cast({col} AS date)) * 86400D"
        if isinstance(dtype, T.DateType):
            return days
        return (f"{days} + hour({col}) * 3600 + minute({col}) * 60"
                f" + cast(extract(SECOND FROM {col}) AS double)")
    if kind == BOOLEAN:
        return f"cast(cast({col} AS int) AS double)"
    if isinstance(dtype, T.FloatType):
        return f"nanvl(cast({col} AS double), cast(null AS double))"
    return f"cast({col} AS double)"


def cell_type(dtypes: list[T.DataType]) -> str:
    """A type that holds the values of all columns and tells them apart."""
    kinds = {family(d) for d in dtypes}
    if kinds <= {INTEGRAL, BOOLEAN}:
        return "bigint"
    wide = any(isinstance(d, (T.LongType, T.DecimalType)) for d in dtypes)
    if kinds <= {INTEGRAL, FRACTIONAL} and not wide:
        return "double"
    return "string"
