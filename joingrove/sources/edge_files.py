"""Saved column relationships."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from joingrove.schemas import EDGES

# Fixed values of the text format.
RECORD_SEPARATOR = ","
FIELD_SEPARATOR = "--"


def parse_edge_text(text: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Edges and malformed records of text rows in the form
    `from_table--to_table--from_col--to_col--weight,` repeated."""
    record = F.explode(F.split(column, RECORD_SEPARATOR)).alias("record")
    records = text.select(record).select(
        F.btrim("record", F.lit(" \r\n\t")).alias("record")).filter(F.col("record") != "")
    parts = F.split("record", FIELD_SEPARATOR)
    weight = F.get(parts, F.lit(4)).try_cast("double")
    good = (F.size(parts) == 5) & weight.isNotNull()
    edges = records.filter(good).select(
        *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(EDGES.names[:4])],
        weight.alias("weight"))
    return edges, records.filter(~good)


def read_edge_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges of a text file, and its malformed records. Records are cut at the
    separator while reading, so a file of any size is split over tasks."""
    return parse_edge_text(spark.read.option("lineSep", RECORD_SEPARATOR).text(path))


def edge_text(edges: DataFrame) -> DataFrame:
    """One text record per edge."""
    return edges.select(
        F.concat_ws(FIELD_SEPARATOR, "from_table", "to_table", "from_col", "to_col",
                    F.col("weight").cast("string")).alias("value"))


def write_edge_text(edges: DataFrame, path: str) -> None:
    edge_text(edges).write.mode("overwrite").option("lineSep", RECORD_SEPARATOR).text(path)


def cache_path(root: str, base: str, threshold: float, matcher: str, tables: list[str]) -> str:
    """Saved edges depend on the base table, threshold, matcher and the tables
    matched: `tables` are their states, so a table elsewhere or written anew is another one."""
    listing = hashlib.md5("\n".join(sorted(tables)).encode()).hexdigest()
    return (f"{root}/edges/base={base.replace('/', '-')}/threshold={threshold}"
            f"/matcher={matcher}/tables={listing}")


def save_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def load_edges(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(EDGES).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing.getCondition()):
            return None
        raise
