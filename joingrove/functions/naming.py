"""Qualified column names and short labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEPARATOR = "__"


def qualify(table: str, column: str) -> str:
    return f"{table}{SEPARATOR}{column}"


def quote(name: str) -> str:
    """SQL text of a column by its exact name, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """SQL text of a string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    return F.col(quote(name))


def short_table_label(table: Column) -> Column:
    """`<dataset>/<first 3>...<last 7>` for table ids longer than 20."""
    parts = F.split(table, "/")
    name = F.coalesce(F.get(parts, F.lit(1)), table)
    prefix = F.when(table.contains("/"), F.concat(F.get(parts, F.lit(0)), F.lit("/"))).otherwise("")
    short = F.concat(prefix, F.substring(name, 1, 3), F.lit("..."), F.right(name, F.lit(7)))
    return F.when(F.length(table) > 20, short).otherwise(table)


def short_column_label(column: Column) -> Column:
    """First and last 10 characters of a column name of 20 or more."""
    short = F.concat(F.substring(column, 1, 10), F.lit("..."), F.right(column, F.lit(10)))
    return F.when(F.length(column) < 20, column).otherwise(short)
