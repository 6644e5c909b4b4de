"""Looking at and editing the scores of a tree.

All edits are set operations on feature_scores, tree_joins and trees; each
returns the changed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def show_features(feature_scores: DataFrame, tree_joins: DataFrame, tree_id: int,
                  selected: bool = True) -> DataFrame:
    """(feature, non_null_ratio, rel, red) of the selected (E1) or, with
    `selected=False`, the discarded features of a tree (E2)."""
    chosen = feature_scores.filter((F.col("tree_id") == tree_id) & (F.col("selected") == selected))
    ratios = tree_joins.select("tree_id", "join_idx", "non_null_ratio")
    return (chosen.join(ratios, ["tree_id", "join_idx"]).groupBy("feature").agg(
        F.min_by("non_null_ratio", "join_idx").alias("non_null_ratio"),
        F.max_by(F.when(F.col("kind") == "rel", F.col("score")),
                 F.when(F.col("kind") == "rel", F.col("join_idx"))).alias("rel"),
        F.max_by(F.when(F.col("kind") == "red", F.col("score")),
                 F.when(F.col("kind") == "red", F.col("join_idx"))).alias("red")))


def _set_score(feature_scores: DataFrame, tree_id: int, feature: str, kind: str,
               value: float) -> DataFrame:
    hit = ((F.col("tree_id") == tree_id) & (F.col("feature") == feature)
           & (F.col("kind") == kind) & F.col("selected"))
    return feature_scores.withColumn("score", F.when(hit, F.lit(float(value))).otherwise(F.col("score")))


def adjust_relevance(feature_scores: DataFrame, tree_id: int, feature: str, value: float) -> DataFrame:
    """Overrides the relevance of a selected feature."""
    return _set_score(feature_scores, tree_id, feature, "rel", value)


def adjust_redundancy(feature_scores: DataFrame, tree_id: int, feature: str, value: float) -> DataFrame:
    """Overrides the redundancy score of a selected feature."""
    return _set_score(feature_scores, tree_id, feature, "red", value)


def adjust_non_null_ratio(tree_joins: DataFrame, tree_id: int, table: str, value: float) -> DataFrame:
    """Overrides the non-null ratio of the join to a table (E5)."""
    hit = (F.col("tree_id") == tree_id) & (F.col("to_table") == table)
    return tree_joins.withColumn(
        "non_null_ratio", F.when(hit, F.lit(float(value))).otherwise(F.col("non_null_ratio")))


def _flip(feature_scores: DataFrame, tree_id: int, features: list[str], selected: bool) -> DataFrame:
    hit = (F.col("tree_id") == tree_id) & F.col("feature").isin(features)
    return feature_scores.withColumn(
        "selected", F.when(hit, F.lit(selected)).otherwise(F.col("selected")))


def _edit_features(trees: DataFrame, tree_id: int, changed: Column) -> DataFrame:
    return trees.withColumn(
        "features", F.when(F.col("tree_id") == tree_id, changed).otherwise(F.col("features")))


def move_to_discarded(trees: DataFrame, feature_scores: DataFrame, tree_id: int,
                      features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Moves selected features to the discarded ones and off the tree."""
    names = F.array(*[F.lit(f) for f in features])
    return (_edit_features(trees, tree_id, F.array_except("features", names)),
            _flip(feature_scores, tree_id, features, False))


def move_to_selected(trees: DataFrame, feature_scores: DataFrame, tree_id: int,
                     features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Moves discarded features to the selected ones and onto the tree."""
    names = F.array(*[F.lit(f) for f in features])
    return (_edit_features(trees, tree_id, F.array_union("features", names)),
            _flip(feature_scores, tree_id, features, True))
