"""Rank, correlation and entropy over many columns in few jobs.

Feature values travel in long form, `(feature, value, n, s)`: `n` rows hold
the value and `s` is the sum of the target over them. The counts are formed
before any shuffle, so a value that fills a third of the rows costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from joingrove.functions.naming import quote, quoted, text
from joingrove.functions.spread import join_spread
from joingrove.functions.types import cell_type, number_sql
from joingrove.sources.staging import stage, stage_observed

# Running counts over more distinct values than this are cut into value ranges,
# so that no task holds all values of one feature. MAX_PIECES bounds the totals
# per range, which are broadcast.
CHUNK_ROWS = 4_000_000
MAX_PIECES = 4096

# Scores are rounded to so many places before they are ordered: sums over a
# cluster differ in their last bits from run to run, and ties go by name.
PLACES = 12

# A correlation or score this close to 0 or 1 counts as 0 or 1.
EPSILON = 1e-12


def numeric_sql(df: DataFrame, columns: list[str]) -> list[str]:
    return [f"{number_sql(c, df.schema[c].dataType)} AS {quote(c)}" for c in columns]


def value_counts(df: DataFrame, features: list[str], target: str | None = None,
                 weight: str | None = None, target_sum: str | None = None) -> DataFrame:
    """(feature, value, n, s) over the non-null values of numeric `features`.

    Rows may stand for several base rows: `weight` then names their number and
    `target_sum` the sum of the target over them.
    """
    n = quote(weight) if weight else "1"
    s = (quote(target_sum) if target_sum
         else number_sql(target, df.schema[target].dataType) if target else "0")
    # Features travel by number; their names would weigh more than the values.
    wide = df.selectExpr(f"cast({n} AS bigint) AS _n", f"cast({s} AS double) AS _s", *[
        f"{number_sql(c, df.schema[c].dataType)} AS `{i}`" for i, c in enumerate(features)])
    long = wide.unpivot(["_n", "_s"], [f"`{i}`" for i in range(len(features))], "place", "value")
    names = ", ".join(text(c) for c in features)
    return (long.filter("value IS NOT NULL AND _s IS NOT NULL")
            .selectExpr("cast(place AS int) AS place", "value", "_n", "_s")
            .groupBy("place", "value").agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"))
            .selectExpr(f"array({names})[place] AS feature", "value", "n", "s"))


def ranked(counts: DataFrame, at_most: int, chunk_rows: int | None = None, order: str = "value",
           weight: str = "n") -> DataFrame:
    """`average_ranks` in as many ranges as the number of distinct values asks for.

    `at_most` bounds that number. Only where it does not fit one task are the
    counts written and counted.
    """
    chunk = chunk_rows or CHUNK_ROWS
    if at_most <= chunk:
        return average_ranks(counts, order, weight=weight)
    counts, seen = stage_observed(counts, "value-counts", F.count(F.lit(1)).alias("n"))
    return average_ranks(counts, order, pieces=min(MAX_PIECES, max(1, -(-seen["n"] // chunk))), weight=weight)


def average_ranks(counts: DataFrame, order: str = "value", partition: str = "feature",
                  pieces: int = 1, weight: str = "n") -> DataFrame:
    """Adds `rank`: 1-based, ties share their average.

    `counts` holds one row per (partition, order) with its number of rows in
    `weight`. With several `pieces` the rows are first cut into ordered ranges,
    written with the number of their range; only the totals per range meet in
    one task.
    """
    upto = (W.unboundedPreceding, W.currentRow)
    n = F.col(weight)
    half = (n + 1) / 2.0
    if pieces <= 1:
        before = F.sum(n).over(W.partitionBy(partition).orderBy(order).rowsBetween(*upto))
        return counts.withColumn("rank", before - n + half)
    # A range may hold the end of one feature and the start of the next.
    placed = stage(counts.repartitionByRange(pieces, partition, order)
                   .withColumn("chunk", F.spark_partition_id()), "ranges")
    totals = placed.groupBy(partition, "chunk").agg(F.sum(n).alias("total"))
    offsets = totals.select(partition, "chunk", (F.sum("total").over(
        W.partitionBy(partition).orderBy("chunk").rowsBetween(*upto)) - F.col("total")).alias("offset"))
    within = F.sum(n).over(W.partitionBy(partition, "chunk").orderBy(order).rowsBetween(*upto))
    # At most MAX_PIECES + features rows.
    return (placed.withColumn("_within", within)
            .join(F.broadcast(offsets), [partition, "chunk"])
            .withColumn("rank", F.col("offset") + F.col("_within") - n + half)
            .drop("chunk", "offset", "_within"))


def rank_columns(df: DataFrame, features: list[str], chunk_rows: int | None = None) -> DataFrame:
    """(feature, value, n, rank) of every numeric column of `df`."""
    counts = value_counts(df, features).select("feature", "value", "n")
    return ranked(counts, df.count() * len(features), chunk_rows)


def pearson(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, score) in one pass without a melt; a column without variance
    scores 0 (D3). Rows where either side is null take no part."""
    wide = df.selectExpr(f"{number_sql(target, df.schema[target].dataType)} AS _y",
                         *numeric_sql(df, features))
    sums, rows = [], []
    for i, f in enumerate(features):
        x = quote(f)
        sums += [f"covar_pop({x}, _y) AS c{i}",
                 f"var_pop(CASE WHEN _y IS NOT NULL THEN {x} END) AS x{i}",
                 f"var_pop(CASE WHEN {x} IS NOT NULL THEN _y END) AS y{i}"]
        rows.append(f"struct({text(f)} AS feature, "
                    f"coalesce(try_divide(c{i}, sqrt(x{i} * y{i})), 0D) AS score)")
    return wide.agg(*[F.expr(e) for e in sums]).selectExpr(f"inline(array({', '.join(rows)}))")


def spearman_of_counts(counts: DataFrame, at_most: int = 0, chunk_rows: int | None = None,
                       order: str = "value") -> DataFrame:
    """(feature, score, low, high) against a 0/1 target, from value counts.

    The average rank of a two-valued target is a linear function of the
    target, so its correlation with a feature's ranks needs only the sum of
    the target per value. Labels rank as their alphabetical codes from 0 do, so
    with `order` "label" no codes are needed.
    """
    n, s, r = F.col("n").cast("double"), F.col("s"), F.col("rank")
    low = F.min("value") if order == "value" else F.lit(0.0)
    high = F.max("value") if order == "value" else (F.count(F.lit(1)) - 1).cast("double")
    sums = ranked(counts, at_most, chunk_rows, order).groupBy("feature").agg(
        F.sum(n).alias("N"), F.sum(s).alias("S"), F.sum(s * r).alias("SR"),
        F.sum(n * n * n - n).alias("ties"), low.alias("low"), high.alias("high"))
    N, S = F.col("N"), F.col("S")
    covariance = F.col("SR") - S * (N + 1) / 2
    rank_variance = (N * N * N - N - F.col("ties")) / 12
    target_variance = S - S * S / N
    return sums.select("feature", _ratio(covariance, rank_variance, target_variance), "low", "high")


def spearman_binary(df: DataFrame, features: list[str], target: str,
                    chunk_rows: int | None = None) -> DataFrame:
    """Spearman against a 0/1 target in one grouping and one ordered pass."""
    return spearman_of_counts(value_counts(df, features, target), df.count() * len(features),
                              chunk_rows).select("feature", "score")


def spearman(df: DataFrame, features: list[str], target: str,
             chunk_rows: int | None = None) -> DataFrame:
    """Pearson of average ranks against any numeric target.

    Ranks are taken over the rows where both sides are present. Fewer than
    two rows are an error.
    """
    rows = df.count()
    if rows < 2:
        raise ValueError("a rank correlation needs more than one row")
    chunk = chunk_rows or CHUNK_ROWS
    y = number_sql(target, df.schema[target].dataType)
    long = df.selectExpr(f"{y} AS _y", *numeric_sql(df, features)).unpivot(
        ["_y"], [quote(f) for f in features], "feature", "value").dropna()
    joint = long.groupBy("feature", "value", "_y").agg(F.count(F.lit(1)).alias("n"))
    at_most, many = rows * len(features), rows * len(features) > chunk
    if many:
        joint, seen = stage_observed(joint, "joint-counts", F.count(F.lit(1)).alias("n"))
        at_most = seen["n"]

    def side(name: str) -> DataFrame:
        counts = joint.groupBy("feature", name).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
        return ranked(counts, at_most, chunk, name)

    def meet(left: DataFrame, ranks: DataFrame, name: str, rank: str) -> DataFrame:
        lookup = ranks.select("feature", name, "pairs", F.col("rank").alias(rank))
        on = ["feature", name]
        # A value with a large share of the pairs is broadcast, not gathered.
        return (join_spread(left, stage(lookup, "ranks"), on, "pairs", at_most) if many
                else left.join(lookup.drop("pairs"), on))

    def ties(ranks: DataFrame, name: str) -> DataFrame:
        n = F.col("n").cast("double")
        return ranks.groupBy("feature").agg(F.sum(n * n * n - n).alias(name), F.sum(n).alias(f"{name}_n"))

    by_x, by_y = side("value"), side("_y")
    with_x = meet(joint, by_x, "value", "rx")
    cross = (meet(stage(with_x, "joint-ranks") if many else with_x, by_y, "_y", "ry")
             .groupBy("feature").agg(F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("XY")))
    sums = cross.join(ties(by_x, "tx"), "feature").join(ties(by_y, "ty"), "feature")
    N = F.col("tx_n")
    cube = N * N * N - N
    return sums.select("feature", _ratio(F.col("XY") - N * (N + 1) * (N + 1) / 4,
                                         (cube - F.col("tx")) / 12, (cube - F.col("ty")) / 12))


def _ratio(covariance: Column, var_x: Column, var_y: Column) -> Column:
    return F.coalesce(F.try_divide(covariance, F.sqrt(var_x * var_y)), F.lit(0.0)).alias("score")


# -- entropy ---------------------------------------------------------------


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n) of every pair of values that occurs."""
    return df.groupBy(quoted(x).alias("x"), quoted(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def entropies(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """(set_id, h): joint entropy, in nats, of each set of up to three columns.

    A null is a value of its own. Rows are only counted for sets that no other
    set contains: each row spreads to one cell per such set, and cells are
    counted before the shuffle. The counts of a set inside another one are sums
    of the other's counts, so what further sets cost depends on distinct cells,
    not on rows.
    """
    kind = cell_type([df.schema[c].dataType for s in sets for c in s])
    above = _containing(sets)
    counts = (_cells(df, {k: s for k, s in enumerate(sets) if above[k] is None}, kind)
              .selectExpr("set_id", "v[x] AS a", "v[y] AS b", "v[z] AS c")
              .groupBy("set_id", "a", "b", "c").agg(F.count(F.lit(1)).alias("n")))
    return _entropy_of_counts(_rolled_up(counts, sets, above, kind))


def entropies_of_codes(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """As `entropies`, for columns of small codes 0..7: a cell is one number."""
    above = _containing(sets)
    counts = (_cells(df, {k: s for k, s in enumerate(sets) if above[k] is None}, "int", blank="0")
              .selectExpr("set_id * 512 + v[x] * 64 + v[y] * 8 + v[z] AS cell")
              .groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
              .selectExpr("shiftright(cell, 9) AS set_id", "shiftright(cell, 6) & 7 AS a", "shiftright(cell, 3) & 7 AS b", "cell & 7 AS c", "n"))
    # At most 216 counts per set are left.
    return _entropy_of_counts(_rolled_up(counts.repartition(1), sets, above, "int", blank="0"))


def _containing(sets: list[tuple[str, ...]]) -> list[int | None]:
    """For each set the smallest other one that contains it; None where there is none."""
    by_column: dict[str, list[int]] = {}
    for k, s in enumerate(sets):
        for c in s:
            by_column.setdefault(c, []).append(k)
    found = []
    for k, s in enumerate(sets):
        wider = [m for m in by_column[s[0]] if len(sets[m]) > len(s) and set(s) < set(sets[m])]
        found.append(min(wider, key=lambda m: (len(sets[m]), m), default=None))
    return found


def _rolled_up(counts: DataFrame, sets: list[tuple[str, ...]], above: list[int | None], kind: str,
               blank: str = "null") -> DataFrame:
    """(set_id, n) of all sets from the counts of those that none contains."""
    every, level = [counts.select("set_id", "n")], counts
    at_hand = [k for k, parent in enumerate(above) if parent is None]
    while at_hand:
        inside: dict[int, list[int]] = {}
        for k, parent in enumerate(above):
            if parent in at_hand:
                inside.setdefault(parent, []).append(k)
        if not inside:
            break

        def kept(k: int, parent: int) -> str:
            places = ([sets[parent].index(c) + 1 for c in sets[k]] + [0, 0])[:3]
            return f"struct({', '.join(map(str, [k] + places))})"

        listing = ", ".join(f"{p}, array({', '.join(kept(k, p) for k in children)})" for p, children in inside.items())
        value = "CASE {0} WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN c ELSE cast(" + blank + " AS " + kind + ") END AS {1}"
        level = (level.selectExpr("a", "b", "c", "n", f"inline(map({listing})[set_id]) AS (child, x, y, z)")
                 .selectExpr("child AS set_id", *[value.format(p, v) for p, v in zip("xyz", "abc")], "n")
                 .groupBy("set_id", "a", "b", "c").agg(F.sum("n").alias("n")))
        every.append(level.select("set_id", "n"))
        at_hand = [k for children in inside.values() for k in children]
    return reduce(DataFrame.unionByName, every)


def _cells(df: DataFrame, sets: dict[int, tuple[str, ...]], kind: str, blank: str = "null") -> DataFrame:
    """Each row once per set: the row's values `v` and the places x, y, z of
    the set's columns in it. Place 0 is blank."""
    used = sorted({c for s in sets.values() for c in s})
    place = {c: i + 1 for i, c in enumerate(used)}
    values = ", ".join([f"cast({blank} AS {kind})"] + [f"cast({quote(c)} AS {kind})" for c in used])
    listing = ", ".join(
        "struct({}, {}, {}, {})".format(i, *([place[c] for c in s] + [0, 0])[:3])
        for i, s in sets.items())
    return df.selectExpr(f"array({values}) AS v").selectExpr(
        "v", f"inline(array({listing})) AS (set_id, x, y, z)")


def _entropy_of_counts(counts: DataFrame) -> DataFrame:
    n, N = F.col("n").cast("double"), F.col("N")
    sums = counts.groupBy("set_id").agg(F.sum(n).alias("N"), F.sum(n * F.log(n)).alias("L"))
    return sums.select("set_id", (F.log(N) - F.col("L") / N).alias("h"))


class EntropyPlan:
    """Scores that are weighted sums of entropies, each column set counted once.

    A term is a dictionary from set id to weight; a score may have several
    terms, which `evaluate` returns one row each.
    """

    def __init__(self):
        self.sets: list[tuple[str, ...]] = []
        self._ids: dict[frozenset, int] = {}

    def h(self, *names: str) -> dict[int, float]:
        key = frozenset(names)
        if key not in self._ids:
            self._ids[key] = len(self.sets)
            self.sets.append(tuple(sorted(key)))
        return {self._ids[key]: 1.0}

    def mutual(self, x: str, y: str) -> dict[int, float]:
        """I(x;y) = H(x) + H(y) - H(xy)."""
        return weigh((1, self.h(x)), (1, self.h(y)), (-1, self.h(x, y)))

    def conditional_entropy(self, x: str, y: str) -> dict[int, float]:
        """H(y|x) = H(xy) - H(x)."""
        return weigh((1, self.h(x, y)), (-1, self.h(x)))

    def conditional_mutual(self, x: str, y: str, z: str) -> dict[int, float]:
        """I(x;y|z) = H(xz) + H(yz) - H(xyz) - H(z)."""
        return weigh((1, self.h(x, z)), (1, self.h(y, z)), (-1, self.h(x, y, z)), (-1, self.h(z)))

    def evaluate(self, df: DataFrame, terms: list[tuple[str, dict[int, float]]],
                 codes: bool = False) -> DataFrame:
        """(feature, term, score) of each (feature, term), from one counting job.

        Sets whose weights cancel are not counted. The entropies, one per set,
        meet the weights in one row.
        """
        rows = [(f, i, k, w) for i, (f, term) in enumerate(terms)
                for k, w in term.items() if abs(w) > EPSILON]
        used = {k: i for i, k in enumerate(sorted({k for _, _, k, _ in rows}))}
        sets = [self.sets[k] for k in used]
        table = entropies_of_codes(df, sets) if codes else entropies(df, sets).repartition(1)
        names = list(dict.fromkeys(f for f, _ in terms))
        weights = ", ".join(f"struct({names.index(f)}, {i}, {used[k]}, {float(w)!r}D)" for f, i, k, w in rows)
        listing = ", ".join(text(f) for f in names)
        return (table.agg(F.map_from_entries(F.collect_list(F.struct("set_id", "h"))).alias("h"))
                .selectExpr("h", f"inline(array({weights})) AS (place, term, set_id, weight)")
                .groupBy("place", "term").agg(F.expr("sum(weight * h[set_id])").alias("score"))
                .selectExpr(f"array({listing})[place] AS feature", "term", "score"))


def weigh(*parts: tuple[float, dict[int, float]]) -> dict[int, float]:
    """Weighted sum of terms."""
    total: dict[int, float] = {}
    for factor, term in parts:
        for k, w in term.items():
            total[k] = total.get(k, 0.0) + factor * w
    return total
