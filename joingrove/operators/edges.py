"""Column relationships as a table of directed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from joingrove.functions.naming import short_table_label
from joingrove.schemas import EDGES

KEY = EDGES.names[:4]


def above(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs strictly more similar than the threshold."""
    return pairs.filter(F.col("weight") > threshold)


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse (B5), from one read of the edges."""
    turned = F.struct(F.col("to_table").alias("from_table"), F.col("from_table").alias("to_table"),
                      F.col("to_col").alias("from_col"), F.col("from_col").alias("to_col"), "weight")
    return edges.select(F.inline(F.array(F.struct(*EDGES.names), turned)))


def edges_from(edges: DataFrame, table: str) -> DataFrame:
    """Edges leaving a table."""
    return edges.filter(F.col("from_table") == table)


def edges_between(edges: DataFrame, from_table: str, to_table: str) -> DataFrame:
    """Edges from one table to another."""
    return edges.filter((F.col("from_table") == from_table) & (F.col("to_table") == to_table))


def edges_of_pair(edges: DataFrame, table1: str, table2: str) -> DataFrame:
    """Edges between two tables in either direction, with short labels."""
    pair = [table1, table2]
    return edges.filter(F.col("from_table").isin(pair) & F.col("to_table").isin(pair)).select(
        short_table_label(F.col("from_table")).alias("from_label"),
        short_table_label(F.col("to_table")).alias("to_label"), *EDGES.names)


def best_edges(edges: DataFrame) -> DataFrame:
    """The heaviest edge of each ordered table pair; ties by column names."""
    first = F.min_by(F.struct("from_col", "to_col"), F.struct(-F.col("weight"), "from_col", "to_col"))
    return edges.groupBy("from_table", "to_table").agg(
        first.alias("cols"), F.max("weight").alias("weight")).select(
        "from_table", "to_table", "cols.from_col", "cols.to_col", "weight")


def weight_matrix(edges: DataFrame, tables: list[str]) -> DataFrame:
    """Best weight of every table pair as a matrix with diagonal 1."""
    cells = edges.filter(F.col("from_table").isin(tables) & F.col("to_table").isin(tables)).select(
        "from_table", "to_table", "weight")
    diagonal = F.array(*[F.lit(t) for t in tables])
    same = edges.sparkSession.range(1).select(F.explode(diagonal).alias("from_table")).select(
        "from_table", F.col("from_table").alias("to_table"), F.lit(1.0).alias("weight"))
    return cells.unionByName(same).groupBy("from_table").pivot("to_table", tables).agg(F.max("weight"))


def column_matrix(edges: DataFrame, table1: str, table2: str, to_cols: list[str]) -> DataFrame:
    """Weights between the columns of two tables as a matrix."""
    return (edges_between(edges, table1, table2).groupBy("from_col")
            .pivot("to_col", to_cols).agg(F.max("weight")))


def _is(edge: tuple[str, str, str, str]) -> Column:
    t1, c1, t2, c2 = edge
    forth = ((F.col("from_table") == t1) & (F.col("from_col") == c1)
             & (F.col("to_table") == t2) & (F.col("to_col") == c2))
    back = ((F.col("from_table") == t2) & (F.col("from_col") == c2)
            & (F.col("to_table") == t1) & (F.col("to_col") == c1))
    return forth | back


def add_edge(edges: DataFrame, table1: str, col1: str, table2: str, col2: str,
             weight: float) -> DataFrame:
    """Adds an edge in both directions."""
    if weight < 0:
        raise ValueError("a weight must not be negative")
    one = edges.sparkSession.range(1).select(
        F.lit(table1).alias("from_table"), F.lit(table2).alias("to_table"),
        F.lit(col1).alias("from_col"), F.lit(col2).alias("to_col"),
        F.lit(float(weight)).alias("weight"))
    return edges.select(*EDGES.names).unionByName(both_directions(one))


def remove_edge(edges: DataFrame, table1: str, col1: str, table2: str, col2: str) -> DataFrame:
    """Removes an edge in both directions."""
    return edges.filter(~_is((table1, col1, table2, col2)))


def update_edge(edges: DataFrame, table1: str, col1: str, table2: str, col2: str,
                weight: float) -> DataFrame:
    """Sets the weight of an edge, which is added where absent."""
    return add_edge(remove_edge(edges, table1, col1, table2, col2),
                    table1, col1, table2, col2, weight)


def without_table(edges: DataFrame, table: str) -> DataFrame:
    """Edges that touch no excluded table."""
    return edges.filter((F.col("from_table") != table) & (F.col("to_table") != table))
