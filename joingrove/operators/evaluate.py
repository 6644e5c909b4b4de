"""Accuracy and feature importance of augmented tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from joingrove import schemas
from joingrove.functions.naming import qualify, quote, quoted
from joingrove.functions.prepare import Range, binary_target, prepare
from joingrove.operators.joins import ROW_ID
from joingrove.operators.models import Algorithm, algorithms
from joingrove.plans.jointree import materialise, top_trees, tree_by_id
from joingrove.sources.catalog import Catalog
from joingrove.sources.staging import stage

# Fixed value: digests below this hexadecimal prefix, 51 of 256, are test rows.
TEST_PREFIX = "33"
# Rows of a range of the order in which test rows exchange values.
RANGE_ROWS = 200_000


def evaluation_table(catalog: Catalog, base_frame: DataFrame, target: str, trees: DataFrame,
                     tree_joins: DataFrame, tree_id: int, hot: dict | None = None) -> DataFrame:
    """Row id, target and tree features without the join keys (F1)."""
    tree = tree_by_id(trees, tree_id).first()
    if tree is None:
        raise ValueError(f"no tree {tree_id}")
    wide = materialise(catalog, base_frame, target, trees, tree_joins, tree_id,
                       include_target=True, keep=[ROW_ID], hot=hot)
    return wide.drop(*[k for k in tree["join_keys"] if k in wide.columns])


def split(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Adds `is_test`, true for about a fifth of the rows (F2). It depends on
    the row id alone, not on partitions or order."""
    digest = F.substring(F.md5(quoted(row_id).cast("string")), 1, 2)
    return df.withColumn("is_test", digest < TEST_PREFIX)


def accuracy(predictions: DataFrame) -> DataFrame:
    """Share of rows where prediction and label agree."""
    return predictions.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def model_rows(table: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """(_rid, label, v array<double>, is_test) and the names behind `v`.

    A null becomes a value below the range of its feature.
    """
    columns = [c for c in table.columns if c not in (target, ROW_ID)]
    labelled = table.withColumn("label", binary_target(table, target).cast("double")).filter(
        "label IS NOT NULL")
    ready, limits = prepare(labelled, columns, [ROW_ID, "label"], parts=True)
    names = list(limits)

    def filled(name: str, limit: Range) -> str:
        below = limit.low - (limit.high - limit.low)
        return f"coalesce({quote(name)}, {below!r}D)"

    values = ", ".join(filled(n, limits[n]) for n in names)
    vector = f"array({values})" if names else "cast(array() AS array<double>)"
    return split(ready.selectExpr(ROW_ID, "label", f"{vector} AS v")), names


def permuted(test: DataFrame, features: int, rows: int) -> DataFrame:
    """Every test row once as it is (`feature` 0) and once per feature with the
    value of that feature taken from another row (F6).

    All rows stand in one order, by a hash of their id, and each takes the value
    of the next, the last that of the first. Ranges of the order go to tasks;
    what crosses their borders is the first row of each.
    """
    parts = max(int(test.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS), 1)
    ordered = test.withColumn("_order", F.xxhash64(quoted(ROW_ID))).repartitionByRange(parts, "_order", ROW_ID).sortWithinPartitions("_order", ROW_ID)
    ordered = stage(ordered.select(ROW_ID, "label", "v").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    # A row per range.
    firsts = ordered.groupBy("_part").agg(F.min_by("v", "_at").alias("_first"))
    line = W.orderBy("_part")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = firsts.withColumn("_after", F.coalesce(F.lead("_first").over(line), F.first("_first").over(whole))).select("_part", "_after")
    mixed = (ordered.withColumn("_next", F.lead("v").over(W.partitionBy("_part").orderBy("_at"))).join(after, "_part")
             .withColumn("_next", F.coalesce("_next", "_after")))
    return (mixed.selectExpr("label", "v", "_next", f"explode(sequence(0, {features})) AS feature")
            .selectExpr("label", "feature", "CASE WHEN feature = 0 THEN v ELSE transform(v, "
                        "(x, i) -> CASE WHEN i = feature - 1 THEN _next[i] ELSE x END) END AS v"))


def evaluate_model(algorithm: Algorithm, rows: DataFrame, names: list[str]
                   ) -> tuple[float, dict[str, float]]:
    """Accuracy on the test rows and the accuracy each feature is worth."""
    train = rows.filter(~F.col("is_test")).select("label", "v")
    test = rows.filter("is_test").select(ROW_ID, "label", "v")
    predict = algorithm.fit(train)
    trial = permuted(test, len(names), test.count())
    right = (predict(trial).groupBy("feature")
             .agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")))
    share = {r["feature"]: r["accuracy"] for r in right.collect()}
    return share[0], {n: share[0] - share[i + 1] for i, n in enumerate(names)}


def evaluate_tree(catalog: Catalog, base_frame: DataFrame, target: str, trees: DataFrame,
                  tree_joins: DataFrame, tree_id: int, algorithm: str | None = "GBM",
                  hot: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and importances of one tree (F8)."""
    chosen = algorithms(algorithm)
    tree = tree_by_id(trees, tree_id).first()
    if tree is None:
        raise ValueError(f"no tree {tree_id}")
    table = stage(evaluation_table(catalog, base_frame, target, trees, tree_joins, tree_id, hot),
                  "evaluation")
    rows, names = model_rows(table, target)
    rows = stage(rows, "model-rows")
    results, importances = [], []
    for one in chosen:
        score, worth = evaluate_model(one, rows, names)
        results.append((tree_id, one.name, one.full_name, float(tree["rank"]), float(score)))
        importances += [(tree_id, one.name, f, float(v)) for f, v in worth.items()]
    spark = catalog.spark
    return (spark.createDataFrame(results, schemas.RESULTS),
            spark.createDataFrame(importances, schemas.IMPORTANCES))


def evaluate_trees(catalog: Catalog, base_frame: DataFrame, target: str, trees: DataFrame,
                   tree_joins: DataFrame, top_k: int = 3, algorithm: str | None = "GBM",
                   hot: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Results and importances of the best trees by rank."""
    spark = catalog.spark
    results = spark.createDataFrame([], schemas.RESULTS)
    importances = spark.createDataFrame([], schemas.IMPORTANCES)
    for row in top_trees(trees, top_k).select("tree_id").collect():
        one, worth = evaluate_tree(catalog, base_frame, target, trees, tree_joins,
                                   row["tree_id"], algorithm, hot)
        results, importances = add_result(results, one), add_result(importances, worth)
    return results, importances


# -- the results as tables ----------------------------------------------------


def add_result(results: DataFrame, more: DataFrame) -> DataFrame:
    """Appends results."""
    return results.unionByName(more)


def best_result(results: DataFrame) -> DataFrame:
    """The most accurate result; ties by tree and model."""
    return results.orderBy(F.desc("accuracy"), "tree_id", "model").limit(1)


def explain_result(results: DataFrame, importances: DataFrame, tree_id: int,
                   model: str = "GBM") -> DataFrame:
    """Accuracy and importances of a tree and model."""
    here = (F.col("tree_id") == tree_id) & (F.col("model") == model)
    return results.filter(here).join(importances, ["tree_id", "model"], "left").select(
        "tree_id", "model", "accuracy", "feature", "importance")


def importance_by_table(importances: DataFrame, table: str) -> DataFrame:
    """Features whose name contains a table id."""
    return importances.filter(F.col("feature").contains(table))


def importance_of(importances: DataFrame, table: str | None = None,
                  column: str | None = None) -> DataFrame:
    """All importances, those of a table, or that of one feature."""
    if table is None:
        return importances
    if column is None:
        return importance_by_table(importances, table)
    return importances.filter(F.col("feature") == qualify(table, column))
