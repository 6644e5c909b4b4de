"""Feature selection while features arrive, one joined table at a time.

A hop never joins to find out whether it should. The partial table shrinks to
one row per join key with its row count and target sum; ratio, ranges, codes
and rank correlations all come from those counts joined to the right table.
Only the features that are relevant, and the keys later hops need, are then
joined to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from joingrove.functions.naming import quote, quoted
from joingrove.functions.prepare import (
    Range, binary_target, category_codes, category_counts, prepare, with_codes)
from joingrove.functions.stats import (
    CHUNK_ROWS, EPSILON, PLACES, numeric_sql, spearman_of_counts, value_counts)
from joingrove.functions.types import OTHER, STRING, families
from joingrove.operators.joins import (
    ROW_ID, Facts, KeySummary, joinable, key_counts, left_join_one, matched_keys, one_row_per_key)
from joingrove.operators.selection import mrmr, normalise
from joingrove.sources.staging import discard, stage, stage_observed

TARGET = "_y"
KEY_PREFIX = "_key__"


@dataclass(frozen=True)
class Options:
    top_k: int = 10
    non_null_threshold: float = 0.5
    method: str = "spearman"
    jmi: bool = False
    binning: str = "uniform5"
    keep_single: bool = False
    chunk_rows: int = CHUNK_ROWS


@dataclass(frozen=True)
class Partial:
    """A partial join: base rows with target, chosen features and open keys."""
    frame: DataFrame
    rows: int
    tables: tuple[str, ...]
    selected: tuple[str, ...]
    limits: dict[str, Range] = field(default_factory=dict)


@dataclass(frozen=True)
class HopResult:
    outcome: str                       # "types", "pruned", "bridge" or "tree"
    ratio: float | None = None
    score: float | None = None
    rel: tuple[tuple[str, float], ...] = ()            # top-k, best first
    rel_discarded: tuple[tuple[str, float], ...] = ()
    red: tuple[tuple[str, float], ...] = ()            # kept, best first
    red_discarded: tuple[tuple[str, float], ...] = ()
    facts: Facts = Facts()
    partial: Partial | None = None


def key_name(column: str) -> str:
    return KEY_PREFIX + column


def start(base: DataFrame, target: str, features: list[str], keys: list[str],
          options: Options = Options()) -> Partial:
    """The base table as the first partial join. Its features are all selected."""
    y = binary_target(base, target)
    row_id = ROW_ID if ROW_ID in base.columns else f"monotonically_increasing_id() AS {ROW_ID}"
    wide = base.withColumn(TARGET, y).selectExpr(
        row_id, TARGET, *[f"{quote(k)} AS {quote(key_name(k))}" for k in keys],
        *[quote(f) for f in features])
    keep = [ROW_ID, TARGET] + [key_name(k) for k in keys]
    frame, limits = prepare(wide, features, keep, parts=False)
    frame, seen = stage_observed(frame.filter(F.col(TARGET).isNotNull()), "base",
                                 F.count(F.lit(1)).alias("rows"))
    return Partial(frame, seen["rows"], (), tuple(features), limits)


@dataclass(frozen=True)
class Labels:
    """Written label counts of the string columns of a hop."""
    counts: DataFrame
    n: int


def relevance_of_keys(keyed: DataFrame, numeric: list[str], labels: Labels | None, options: Options,
                      keys: int) -> DataFrame | None:
    """(feature, score, low, high) of right columns from per-key counts."""
    chunk, scores = options.chunk_rows, None
    if numeric:
        counts = value_counts(keyed, numeric, weight="_n", target_sum="_s")
        scores = (spearman_of_counts(counts, keys * len(numeric), chunk) if options.method == "spearman"
                  else _pearson(counts))
    if labels:
        if options.method == "spearman":
            part = spearman_of_counts(labels.counts, labels.n, chunk, "label")
        else:
            part = _pearson(category_codes(labels.counts, labels.n, chunk)
                            .select("feature", F.col("code").alias("value"), "n", "s"))
        scores = part if scores is None else scores.unionByName(part)
    return scores


@dataclass(frozen=True)
class Relevance:
    """The k best features with their ranges, and all others."""
    top: tuple[tuple[str, float, Range], ...]
    rest: tuple[tuple[str, float], ...]


def best_features(scores: list[tuple[str, float, float, float]], k: int) -> Relevance:
    """The k most relevant of (feature, score, low, high), ties by name.

    A column of one value is no feature; scores that round to 0 or 1 never are
    among the best.
    """
    found = [(f, round(abs(v), PLACES), Range(lo, hi)) for f, v, lo, hi in scores if lo < hi]
    order = sorted(found, key=lambda r: (-r[1], r[0]))
    valid = [r for r in order if EPSILON < r[1] < 1 - EPSILON]
    top = tuple(valid[:k])
    names = {f for f, _, _ in top}
    return Relevance(top, tuple((f, v) for f, v, _ in order if f not in names))


def mean_score(rel: tuple[tuple[str, float], ...], red: tuple[tuple[str, float], ...]) -> float:
    """What a hop is worth: mean relevance of its best plus mean redundancy of
    the kept features (C13)."""
    return round(sum(v for _, v in rel) / len(rel) + sum(v for _, v in red) / len(red), PLACES)


def _pearson(counts: DataFrame) -> DataFrame:
    """Pearson against a 0/1 target from value counts, around the mean."""
    n, s, v = F.col("n").cast("double"), F.col("s"), F.col("value")
    means = counts.groupBy("feature").agg(
        F.sum(n).alias("N"), F.sum(s).alias("S"), (F.sum(n * v) / F.sum(n)).alias("mean"))
    d = v - F.col("mean")
    sums = counts.join(means, "feature").groupBy("feature").agg(
        F.first("N").alias("N"), F.first("S").alias("S"), F.sum(s * d).alias("C"),
        F.sum(n * d * d).alias("V"), F.min(v).alias("low"), F.max(v).alias("high"))
    spread = F.sqrt(F.col("V") * (F.col("S") - F.col("S") * F.col("S") / F.col("N")))
    return sums.select("feature", F.coalesce(F.try_divide(F.col("C"), spread), F.lit(0.0))
                       .alias("score"), "low", "high")


def hop(partial: Partial, right: DataFrame, right_table: str, left_key: str, right_key: str,
        carry: list[str], options: Options, last: bool = False) -> HopResult:
    """Join one more table and score what it brings.

    `right` has qualified columns, `left_key` and `right_key` are qualified,
    `carry` lists right columns later hops join on. With `last` nothing will be
    joined to the outcome, which then need not be written.
    """
    left_column = key_name(left_key)
    if left_column not in partial.frame.columns:
        return HopResult("types")
    if not joinable(partial.frame, left_column, right, right_key):
        return HopResult("types")
    counts, seen = stage_observed(
        matched_keys(key_counts(partial.frame, left_column, TARGET), right, right_key), "keys",
        *KeySummary.metrics(partial.rows))
    summary = KeySummary.of(seen)
    if not summary.passes(options.non_null_threshold):
        discard(counts)
        return HopResult("pruned", summary.ratio)

    # One row per key that occurs on both sides.
    kinds = families(right.schema)
    strings = [c for c in right.columns if kinds[c] == STRING]
    numeric = [c for c in right.columns if kinds[c] not in (STRING, OTHER)]
    right_one = one_row_per_key(right, right_key, unique=summary.facts.unique)
    keyed = stage(counts.filter("_hit").join(right_one, F.col("_key") == quoted(right_key))
                  .drop("_key", "_hit", "_copies"), "right")
    labels = None
    if strings:
        held, count = stage_observed(category_counts(keyed, strings, "_n", "_s"), "labels", F.count(F.lit(1)).alias("n"))
        labels = Labels(held, count["n"])
    scores = relevance_of_keys(keyed, numeric, labels, options, summary.keys)
    found = best_features([] if scores is None else [
        (r["feature"], r["score"], r["low"], r["high"]) for r in scores.collect()], options.top_k)
    rel, rel_discarded = tuple((f, v) for f, v, _ in found.top), found.rest
    names = [f for f, _ in rel]
    limits = {**partial.limits, **{f: r for f, _, r in found.top}}

    joined = partial.frame
    if names or carry:
        joined = _join(partial, keyed, left_column, right_key, names, labels, carry, summary, options)
        if not last:
            joined = stage(joined, "partial")
    if not last or not (names or carry):  # nothing reads what the join was made of
        for frame in [counts, keyed] + ([labels.counts] if labels else []):
            discard(frame)

    red, red_discarded = (), ()
    if names:
        present = [f for f in partial.selected if f in partial.limits]
        red, red_discarded = _redundancy(joined, names, present, limits, options)
    tables = partial.tables + (right_table,)
    if not red:
        bridge = Partial(joined.drop(*names), partial.rows, tables, partial.selected, partial.limits)
        return HopResult("bridge", summary.ratio, None, (), rel_discarded + rel, (), red_discarded,
                         summary.facts, bridge)
    final = [f for f, _ in red]
    score = mean_score(rel, red)
    grown = Partial(joined.drop(*[f for f in names if f not in final]), partial.rows, tables,
                    partial.selected + tuple(final), limits)
    return HopResult("tree", summary.ratio, score, rel, rel_discarded, red, red_discarded,
                     summary.facts, grown)


def _join(partial: Partial, keyed: DataFrame, left_column: str, right_key: str, names: list[str],
          labels: Labels | None, carry: list[str], summary: KeySummary,
          options: Options) -> DataFrame:
    """Rows of the partial join with the new features and keys, nothing else."""
    kinds = families(keyed.schema)
    chosen = [c for c in names if kinds[c] == STRING]
    right = keyed.selectExpr(f"{quote(right_key)} AS _rkey",
                             *[f"{quote(c)} AS {quote(key_name(c))}" for c in carry],
                             *[quote(c) for c in chosen],
                             *numeric_sql(keyed, [c for c in names if c not in chosen]))
    if chosen:
        codes = category_codes(labels.counts, labels.n, options.chunk_rows).filter(F.col("feature").isin(chosen))
        right, _ = with_codes(right, stage(codes, "codes"), chosen)
    kept = [ROW_ID, TARGET] + [c for c in partial.frame.columns if c.startswith(KEY_PREFIX)]
    kept += [f for f in partial.selected if f in partial.limits]
    left = partial.frame.selectExpr(*[quote(c) for c in kept])
    joined = left_join_one(left, left_column, right, "_rkey", list(summary.hot), summary.facts.salts)
    return joined.drop("_rkey")


def _redundancy(joined: DataFrame, names: list[str], selected: list[str],
                limits: dict[str, Range], options: Options):
    raw = mrmr(joined, names, selected, TARGET, options.binning, limits, options.jmi)
    rows = [(r["feature"], round(r["score"], PLACES), r["selected"]) for r in normalise(raw).collect()]
    if options.keep_single and len(rows) == 1:
        rows = [(rows[0][0], 1.0, True)]
    rows.sort(key=lambda r: (-r[1], r[0]))
    return (tuple((f, v) for f, v, keep in rows if keep),
            tuple((f, v) for f, v, keep in rows if not keep))
