"""Relevance and redundancy of features.

Every function returns one small table, `(feature, score, selected)`, with one
row per feature scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from joingrove.functions.prepare import Range, binned
from joingrove.functions.stats import EPSILON, PLACES, EntropyPlan, pearson, spearman, spearman_binary, weigh


def mark_relevant(correlations: DataFrame) -> DataFrame:
    """Absolute correlation; selected iff strictly between 0 and 1."""
    size = F.round(F.abs("score"), PLACES)
    return correlations.select(
        "feature", size.alias("score"),
        ((size > EPSILON) & (size < 1 - EPSILON)).alias("selected"))


def measure_relevance(df: DataFrame, features: list[str], target: str,
                      method: str = "spearman", binary: bool = True,
                      ordered: bool = True) -> DataFrame:
    """Absolute correlation with the target of the features present.

    The target itself is never scored. Selected rows come first, best first.
    """
    present = [f for f in dict.fromkeys(features) if f in df.columns and f != target]
    if not present:
        return df.sparkSession.createDataFrame([], "feature string, score double, selected boolean")
    if method == "pearson":
        scores = pearson(df, present, target)
    elif binary:
        scores = spearman_binary(df, present, target)
    else:
        scores = spearman(df, present, target)
    scores = mark_relevant(scores)
    # A feature without a value has no correlation; it is scored 0 and discarded.
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in present])).alias("feature"))
    scores = names.join(scores, "feature", "left").fillna({"score": 0.0, "selected": False})
    if ordered:
        scores = scores.orderBy(F.desc("selected"), F.desc("score"), "feature")
    return scores


def normalise(scores: DataFrame) -> DataFrame:
    """Min-max scale (feature, score); selected iff above 0.

    All scores 0: nothing comes back. All scores equal: all scale to 0. The
    table has one row per feature, so it is folded into one array.
    """
    folded = scores.agg(
        F.collect_list(F.struct("feature", "score")).alias("rows"),
        F.min("score").alias("low"), F.max("score").alias("high"),
        F.max(F.abs("score")).alias("peak"))
    folded = folded.filter(F.col("peak") > EPSILON)
    spread = F.col("high") - F.col("low")

    def scaled(row: Column) -> Column:
        share = F.round(F.when(spread > EPSILON, (row["score"] - F.col("low")) / spread).otherwise(0.0), PLACES)
        return F.struct(row["feature"].alias("feature"), share.alias("score"),
                        (share > EPSILON).alias("selected"))

    return folded.select(F.inline(F.transform("rows", scaled)))


def _averaged(terms: list[dict[int, float]]) -> list[tuple[float, dict[int, float]]]:
    return [(1 / len(terms), t) for t in terms]


def mrmr(df: DataFrame, new: list[str], selected: list[str], target: str,
         binning: str = "uniform5", limits: dict[str, Range] | None = None,
         jmi: bool = False) -> DataFrame:
    """(feature, score): I(f;y) - mean over selected s of I(s;f).

    With `jmi` the mean of I(s;f|y), on unbinned values, is added (D15).
    Without selected features only the first term remains. `target` is 0/1.
    """
    selected = [s for s in selected if s in df.columns and s not in new]
    codes = binning == "uniform5"
    data = binned(df, new + selected, [target], limits) if codes else df
    plan = EntropyPlan()
    terms = []
    for f in new:
        shared = [plan.mutual(s, f) for s in selected]
        terms.append((f, weigh((1, plan.mutual(f, target)), *[(-w, t) for w, t in _averaged(shared)])))
    scores = plan.evaluate(data, terms, codes)
    if jmi and selected:
        raw = EntropyPlan()
        gains = [(f, weigh(*_averaged([raw.conditional_mutual(s, f, target) for s in selected])))
                 for f in new]
        scores = scores.unionByName(raw.evaluate(df, gains))
        return scores.groupBy("feature").agg(F.sum("score").alias("score"))
    return scores.select("feature", "score")


def measure_redundancy(df: DataFrame, selected: list[str], relevant: list[str], target: str,
                       binning: str = "uniform5", limits: dict[str, Range] | None = None,
                       jmi: bool = False) -> DataFrame:
    """Normalised mRMR (D14-D16): the lowest scorer is never selected."""
    return normalise(mrmr(df, relevant, selected, target, binning, limits, jmi))


def measure_relevance_and_redundancy(df: DataFrame, selected: list[str], new: list[str],
                                     target: str, method: str = "spearman"
                                     ) -> tuple[DataFrame, DataFrame | None]:
    """Relevance, then redundancy of what it kept (D17). The names kept, at
    most one per column, travel over the driver."""
    relevance = measure_relevance(df, new, target, method)
    kept = [r["feature"] for r in relevance.filter("selected").collect()]
    return relevance, measure_redundancy(df, selected, kept, target) if kept else None


def measure_conditional_redundancy(df: DataFrame, selected: list[str], new: list[str],
                                   target: str) -> DataFrame:
    """CMIM: the least I(f;y|s) over the selected s, normalised."""
    plan = EntropyPlan()
    terms = []
    for f in new:
        terms += [(f, plan.conditional_mutual(f, target, s)) for s in selected if s != f]
        if not any(s != f for s in selected):
            terms.append((f, plan.mutual(f, target)))
    scores = plan.evaluate(df, terms)
    return normalise(scores.groupBy("feature").agg(F.min("score").alias("score")))


def measure_group_redundancy(df: DataFrame, group: list[str], target: str) -> DataFrame:
    """Mean over the other features g of I(f;y|g); selected iff above 0.
    A group of fewer than two features comes back unscored and selected."""
    if len(group) < 2:
        return df.sparkSession.createDataFrame(
            [(f, None, True) for f in group], "feature string, score double, selected boolean")
    plan = EntropyPlan()
    terms = [(f, plan.conditional_mutual(f, target, g)) for f in group for g in group if g != f]
    return plan.evaluate(df, terms).groupBy("feature").agg(F.avg("score").alias("score")).withColumn(
        "selected", F.col("score") > EPSILON)


def measure_joint_mutual_information(df: DataFrame, selected: list[str], new: list[str],
                                     target: str) -> DataFrame:
    """mRMR on the values as they are, normalised."""
    return normalise(mrmr(df, new, selected, target, binning="none"))
