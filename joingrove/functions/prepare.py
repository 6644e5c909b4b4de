"""From table columns to numeric features: types, codes, date parts, bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from joingrove.functions.naming import SEPARATOR, quote, quoted
from joingrove.functions.stats import numeric_sql, ranked
from joingrove.functions.types import BOOLEAN, NUMERIC, OTHER, STRING, TIMESTAMP, families, number_sql
from joingrove.sources.staging import stage, stage_observed

# Labels and characters up to which the codes of a column are broadcast; other
# codes are joined by a shuffle.
BROADCAST_LABELS, BROADCAST_CHARS = 10_000, 4_000_000
# Tasks over which the rows of a hot or missing label are spread.
SPREAD = 997
BINS = 5
# The calendar parts of a time column.
DATE_PARTS = ("year", "month", "day", "dayofweek")
PART_SQL = {"year": "year", "month": "month", "day": "dayofmonth", "dayofweek": "dayofweek"}


@dataclass(frozen=True)
class Range:
    """Smallest and largest value of a feature."""
    low: float
    high: float


def binary_target(df: DataFrame, target: str) -> Column:
    """0/1 column of a two-valued target; the smaller label is 0."""
    labels = sorted(r[0] for r in df.select(quoted(target)).filter(quoted(target).isNotNull())
                    .distinct().limit(3).collect())
    if len(labels) != 2:
        raise ValueError(f"target {target!r} must have two values")
    return F.when(quoted(target) == F.lit(labels[1]), 1).when(
        quoted(target) == F.lit(labels[0]), 0)


def profile(df: DataFrame, columns: list[str]) -> tuple[dict[str, Range], list[str]]:
    """Ranges of the numeric-like columns and the categories, in one pass that
    returns one row. Columns without two values are left out."""
    kinds = families(df.schema)
    aggs = []
    for i, c in enumerate(columns):
        if kinds[c] in NUMERIC or kinds[c] in (BOOLEAN, TIMESTAMP):
            x = number_sql(c, df.schema[c].dataType)
            aggs += [F.expr(f"min({x})").alias(f"lo{i}"), F.expr(f"max({x})").alias(f"hi{i}")]
        elif kinds[c] == STRING:
            aggs.append(F.coalesce(F.min(quoted(c)) < F.max(quoted(c)), F.lit(False)).alias(f"ok{i}"))
    if not aggs:
        return {}, []
    row = df.agg(*aggs).first()
    ranges, categories = {}, []
    for i, c in enumerate(columns):
        if kinds[c] == STRING and row[f"ok{i}"]:
            categories.append(c)
        elif kinds[c] in NUMERIC or kinds[c] in (BOOLEAN, TIMESTAMP):
            low, high = row[f"lo{i}"], row[f"hi{i}"]
            if low is not None and low < high:
                ranges[c] = Range(low, high)
    return ranges, categories


def category_counts(df: DataFrame, columns: list[str], weight: str | None = None,
                    target_sum: str | None = None) -> DataFrame:
    """(feature, label, n, s) of string columns."""
    n = quote(weight) if weight else "1"
    s = quote(target_sum) if target_sum else "0"
    long = df.selectExpr(f"cast({n} AS bigint) AS _n", f"cast({s} AS double) AS _s",
                         *[f"cast({quote(c)} AS string) AS {quote(c)}" for c in columns]).unpivot(
        ["_n", "_s"], [quote(c) for c in columns], "feature", "label")
    return (long.filter("label IS NOT NULL").groupBy("feature", "label")
            .agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")))


def category_codes(counts: DataFrame, at_most: int, chunk_rows: int | None = None) -> DataFrame:
    """Adds `code`, alphabetical from 0 in each feature, to `category_counts`;
    `at_most` bounds the number of labels. Many labels are numbered range by range."""
    one = counts.withColumn("_one", F.lit(1).cast("bigint"))
    return (ranked(one, at_most, chunk_rows, "label", "_one")
            .withColumn("code", F.col("rank") - 1.0).drop("rank", "_one"))


def with_codes(df: DataFrame, codes: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """`columns` with codes in place of labels, and the largest code of each.

    `codes` should be written before: it is read once per column. Few short
    labels are broadcast. Otherwise rows and codes meet by label, where the rows
    of the labels above 1 / SPREAD of all, and rows without one, are spread.
    """
    found = {r["feature"]: r for r in codes.groupBy("feature").agg(
        F.max("code").alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows"),
        F.sum(F.length("label")).alias("chars")).collect()}
    for c in [c for c in columns if c in found]:
        size = found[c]
        lookup = codes.filter(F.col("feature") == c)
        few = size["labels"] <= BROADCAST_LABELS and size["chars"] <= BROADCAST_CHARS
        hot = lookup if few else lookup.filter(F.col("n") > size["rows"] // SPREAD)  # fewer than SPREAD labels
        named = hot.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        df = df.join(F.broadcast(named), quoted(c) == F.col("_label"), "left").drop("_label")
        if not few:
            cold = lookup.filter(F.col("n") <= size["rows"] // SPREAD).select(
                F.col("label").alias("_label"), F.col("code").alias("_cold"), F.lit(0).alias("_spread"))
            kinds = families(df.schema)
            others = [quote(x) for x in df.columns if x not in (c, "_code") and kinds[x] != OTHER]
            place = F.pmod(F.expr(f"xxhash64({', '.join(others) or '0'})"), F.lit(SPREAD)).cast("int") + 1
            done = F.col("_code").isNotNull() | quoted(c).isNull()
            df = df.withColumn("_at", F.when(done, place).otherwise(0))
            df = (df.join(cold, (quoted(c) == F.col("_label")) & (F.col("_at") == F.col("_spread")), "left")
                  .withColumn("_code", F.coalesce("_code", "_cold")).drop("_label", "_cold", "_spread", "_at"))
        df = df.withColumn(c, F.col("_code")).drop("_code")
    return df, {c: r["top"] for c, r in found.items()}


def date_parts(column: str) -> list[str]:
    """SQL of the calendar parts of a time column, named `<column>__<part>`."""
    return [f"cast({PART_SQL[p]}(cast({quote(column)} AS date)) AS double) "
            f"AS {quote(column + SEPARATOR + p)}" for p in DATE_PARTS]


def date_like(df: DataFrame, columns: list[str]) -> list[str]:
    """String columns whose every value starts with a day as `2024-01-31`."""
    strings = [c for c in columns if families(df.schema)[c] == STRING]
    if not strings:
        return []
    is_day = [quoted(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?$") & quoted(c).try_cast("timestamp_ntz").isNotNull()
              for c in strings]
    row = df.agg(*[(F.count(quoted(c)) > 0).alias(f"any{i}") for i, c in enumerate(strings)],
                 *[F.coalesce(F.min(F.when(quoted(c).isNotNull(), d)), F.lit(False)).alias(f"all{i}")
                   for i, (c, d) in enumerate(zip(strings, is_day))]).first()
    return [c for i, c in enumerate(strings) if row[f"any{i}"] and row[f"all{i}"]]


def prepare(df: DataFrame, columns: list[str], keep: list[str], parts: bool = True
            ) -> tuple[DataFrame, dict[str, Range]]:
    """Numeric form of `columns` beside the untouched `keep`, with the range of
    every feature (D1).

    Numbers and booleans become doubles, times seconds and calendar parts,
    strings alphabetical codes. With `parts`, strings that are all days count as
    times. Columns without two values drop out.
    """
    days = date_like(df, columns) if parts else []
    if days:
        df = df.withColumns({c: quoted(c).try_cast("timestamp_ntz") for c in days})
    kinds = families(df.schema)
    times = [c for c in columns if kinds[c] == TIMESTAMP] if parts else []
    wide = df.selectExpr(*[quote(c) for c in keep], *[quote(c) for c in columns],
                         *[p for c in times for p in date_parts(c)])
    names = columns + [f"{c}{SEPARATOR}{p}" for c in times for p in DATE_PARTS]
    ranges, categories = profile(wide, names)
    if categories:
        counts, seen = stage_observed(category_counts(wide, categories), "labels", F.count(F.lit(1)).alias("n"))
        codes = stage(category_codes(counts, seen["n"]), "codes")
        wide, tops = with_codes(wide, codes, categories)
        ranges.update({c: Range(0.0, tops[c]) for c in categories})
    kept = [c for c in names if c in ranges]
    return wide.selectExpr(*[quote(c) for c in keep], *numeric_sql(wide, kept)), {
        c: ranges[c] for c in kept}


def bin_sql(value: str, limits: Range, bins: int = BINS) -> str:
    """Equal-width bin 1..bins of a numeric SQL value; null is bin 0, a constant bin 1."""
    if limits.high <= limits.low:
        return f"CASE WHEN {value} IS NULL THEN 0 ELSE 1 END"
    share = f"({value} - {limits.low!r}D) / {limits.high - limits.low!r}D"
    return (f"CASE WHEN {value} IS NULL THEN 0 "
            f"ELSE least(cast(floor({share} * {bins}) AS int), {bins - 1}) + 1 END")


def ranges_of(df: DataFrame, columns: list[str]) -> dict[str, Range]:
    """Range of numeric columns, constants included, in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        x = number_sql(c, df.schema[c].dataType)
        aggs += [F.expr(f"min({x})").alias(f"lo{i}"), F.expr(f"max({x})").alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: Range(row[f"lo{i}"] if row[f"lo{i}"] is not None else 0.0,
                     row[f"hi{i}"] if row[f"hi{i}"] is not None else 0.0)
            for i, c in enumerate(columns)}


def binned(df: DataFrame, columns: list[str], keep: list[str],
           limits: dict[str, Range] | None = None, bins: int = BINS) -> DataFrame:
    """`keep` and the bin of each of `columns`."""
    limits = limits or ranges_of(df, columns)
    return df.selectExpr(*[quote(c) for c in keep], *numeric_sql(df, columns)).selectExpr(
        *[quote(c) for c in keep],
        *[f"{bin_sql(quote(c), limits[c], bins)} AS {quote(c)}" for c in columns])
