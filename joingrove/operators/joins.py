"""The join every tree is made of: one right row per key, kept whole on the left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from joingrove.functions.naming import quote, quoted
from joingrove.functions.types import OTHER, families, family
from joingrove.sources.staging import stage, stage_observed

# A key with more than this share of the left rows is spread over tasks. At
# most 1 / HOT_SHARE keys can be hot, whatever the data.
HOT_SHARE = 0.002
SALTS = 64
# Rows of one hot key that one task takes; larger keys are spread over more than SALTS tasks.
ROWS_PER_TASK = 1_000_000

# Pairs of one key that a task of a join without the one-row step makes, and keys that are dealt over several.
PAIRS_PER_TASK = 4_000_000
MAX_GRIDS = 10_000
# Right rows of such keys that every task holds, and their characters as text: so few stand in all tasks and
# neither side is copied. Else the rows of a side are copied so often as makes COPIES times those of both.
HELD_ROWS, HELD_CHARS = 500_000, 1 << 24
COPIES = 4

# Identity of a base row, carried through every join.
ROW_ID = "_rid"


def joinable(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> bool:
    """Whether the two key columns are of the same type family."""
    kind = family(left.schema[left_key].dataType)
    return kind == family(right.schema[right_key].dataType) and kind != OTHER


def one_row_per_key(right: DataFrame, key: str, columns: list[str] | None = None,
                    seed: int | None = None, unique: bool = False) -> DataFrame:
    """One row of each non-null key.

    Where the keys read are known to be `unique`, the rows are passed on as they are.

    The row is the least one over all other columns, nulls first, in column
    order; with a seed, the least by a seeded digest. It is an aggregate, so a
    hot key shrinks to one row per task before the shuffle, and a join to
    columns nobody reads is dropped from the plan. `columns` only narrows what
    comes back.
    """
    kinds = families(right.schema)
    others = [c for c in right.columns if c != key and kinds[c] != OTHER]
    kept = [c for c in (columns or right.columns) if c == key or c in others]
    present = right.filter(f"{quote(key)} IS NOT NULL")
    if unique:
        return present.selectExpr(*[quote(c) for c in kept])
    if not others:
        return present.select(quoted(key)).distinct()
    row = f"struct({', '.join(quote(c) for c in others)})"
    least = f"min({row})" if seed is None else (
        f"min_by({row}, struct(md5(concat('{seed}|', to_json({row}))), {row}))")
    return present.groupBy(quoted(key)).agg(F.expr(least).alias("_row")).selectExpr(*[
        quote(c) if c == key else f"_row.{quote(c)} AS {quote(c)}" for c in kept])


def key_counts(left: DataFrame, key: str, target: str | None = None) -> DataFrame:
    """(key, n, s): left rows per key and their target sum. A hot key is one
    row from here on; null is a key like any other."""
    s = quoted(target) if target else F.lit(0)
    return left.groupBy(quoted(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(s).alias("_s"))


def matched_keys(counts: DataFrame, right: DataFrame, right_key: str) -> DataFrame:
    """Key counts with `_hit`: whether the key occurs on the right, and `_copies`: how often."""
    keys = (right.select(quoted(right_key).alias("_rkey")).filter(F.col("_rkey").isNotNull())
            .groupBy("_rkey").agg(F.count(F.lit(1)).alias("_copies")))
    return counts.join(keys, F.col("_key") == F.col("_rkey"), "left").withColumn(
        "_hit", F.col("_rkey").isNotNull()).drop("_rkey")


@dataclass(frozen=True)
class Facts:
    """What a join is run with: its hot keys, the tasks each is spread over, and whether the right keys it
    meets are unique."""
    hot: tuple = ()
    salts: int = SALTS
    unique: bool = False


@dataclass(frozen=True)
class KeySummary:
    """What the matched key counts tell about a join."""
    rows: int
    keys: int
    ratio: float | None            # share of left rows whose key occurs on the right (C9)
    facts: Facts

    @property
    def hot(self) -> tuple:
        return self.facts.hot

    def passes(self, threshold: float) -> bool:
        """At or above the threshold; an empty left side never passes."""
        return self.ratio is not None and self.ratio >= threshold

    @staticmethod
    def metrics(total: int, share: float = HOT_SHARE) -> list[Column]:
        """Aggregates over `matched_keys`. `total` is the number of left rows;
        keys above `share` of them are hot, so at most 1 / share are listed."""
        busy = F.col("_n") > int(total * share)
        return [F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("keys"),
                F.sum(F.when(F.col("_hit"), F.col("_n")).otherwise(0)).alias("hit"),
                F.collect_list(F.when(busy, F.col("_key"))).alias("hot"),
                F.max("_n").alias("largest"), F.max("_copies").alias("copies"),
                F.max(busy & F.col("_key").isNull()).alias("hot_null")]

    @staticmethod
    def of(found: dict) -> "KeySummary":
        ratio = found["hit"] / found["rows"] if found["rows"] else None
        hot = tuple(found["hot"]) + ((None,) if found["hot_null"] else ())
        salts = max(SALTS, -(-(found["largest"] or 0) // ROWS_PER_TASK))
        return KeySummary(found["rows"] or 0, found["keys"], ratio, Facts(hot, salts, (found["copies"] or 0) <= 1))


def key_summary(counts: DataFrame, total: int, right: DataFrame, right_key: str) -> KeySummary:
    """Ratio, number of keys and hot keys of a join in one job."""
    row = matched_keys(counts, right, right_key).agg(*KeySummary.metrics(total)).first()
    return KeySummary.of(row.asDict())


def left_join_one(left: DataFrame, left_key: str, right_one: DataFrame, right_key: str,
                  hot: list | None = None, salts: int = SALTS) -> DataFrame:
    """Left equi-join to a table with one row per key (C8): exactly the rows of
    the left side come out.

    Rows of `hot` keys (null among them) are spread over `salts` tasks, and the
    one right row of such a key is copied to each. At most `salts` times
    `len(hot)` rows are added on the right.
    """
    on = quoted(left_key) == quoted(right_key)
    if not hot:
        return left.join(right_one, on, "left")
    values = [v for v in hot if v is not None]
    never = F.lit(False)
    is_hot_left = (quoted(left_key).isin(values) if values else never) | quoted(left_key).isNull()
    is_hot_right = quoted(right_key).isin(values) if values else never
    identity = [ROW_ID] if ROW_ID in left.columns else [
        c for c in left.columns if family(left.schema[c].dataType) != OTHER]
    spread = F.expr(f"xxhash64({', '.join(quote(c) for c in identity)})")
    salted_left = left.withColumn("_salt", F.when(
        F.coalesce(is_hot_left, F.lit(False)), F.pmod(spread, F.lit(salts))).otherwise(0).cast("int"))
    copies = F.when(is_hot_right, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right_one.withColumn("_rsalt", F.explode(copies))
    return salted_left.join(salted_right, on & (F.col("_salt") == F.col("_rsalt")), "left").drop(
        "_salt", "_rsalt")


def left_join_all(left: DataFrame, left_key: str, right: DataFrame, right_key: str,
                  pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Left join without the one-row step: rows fan out, null meets null (C19, `dedupe=False`).

    A key with more than `pairs_per_task` pairs gets a grid: its left rows are dealt to rows of the grid, its
    right ones to columns, and each is copied along, so a task joins no more than a cell. The sides of the
    grid follow the numbers of rows, which keeps the copies few beside the pairs that they make; where they would
    be many times the rows of both sides, cells are larger. Where the right rows of all such keys are few, every
    task holds them, the left ones are dealt to tasks and no row is copied. Keys with no partner are dealt as well.
    Fewer than MAX_GRIDS keys have a grid, whatever the data.
    """
    pairs = F.col("_nl") * F.greatest("_nr", F.lit(1))
    counts, seen = stage_observed(_both_counts(left, left_key, right, right_key), "pair-counts",
                                  F.sum(pairs).alias("pairs"), F.max(pairs).alias("most"))
    total = int(seen["pairs"] or 0)
    limit = max(pairs_per_task, total // MAX_GRIDS)
    on = quoted(left_key).eqNullSafe(quoted(right_key))
    if int(seen["most"] or 0) <= limit:
        return left.join(right, on, "left")
    busy = counts.filter(pairs > limit)
    grid = F.broadcast(_grids(busy, limit))
    # A row keeps its place in the grid when a task is run again: by its place in written files.
    left = stage(left, "fan-out")
    of_grid = ["_at", "_gkey", "_meets", "_across", "_down"]
    placed = left.withColumn("_at", F.monotonically_increasing_id()).join(grid, quoted(left_key).eqNullSafe(F.col("_gkey")), "left")
    dealt = right.withColumn("_at", F.monotonically_increasing_id()).join(
        grid.filter("_meets"), quoted(right_key).eqNullSafe(F.col("_gkey")), "left")
    columns = [quoted(c) for c in left.columns + right.columns]
    own = F.coalesce(F.pmod("_at", F.col("_down")), F.lit(0)).cast("int")
    if _held(busy, dealt.filter("_meets").drop(*of_grid)):
        # By a fixed number: tasks are dear by the pairs they make, not by the bytes they read.
        tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * left.sparkSession.sparkContext.defaultParallelism,
                    min(total // PAIRS_PER_TASK, MAX_GRIDS))
        many = placed.filter("_meets").repartition(tasks, "_at").drop(*of_grid)
        in_grid = many.join(F.broadcast(dealt.filter("_meets").drop(*of_grid)), on).select(*columns)
    else:
        line = lambda cells: F.sequence(F.lit(0), F.col(cells) - 1)
        many = placed.filter("_meets").withColumn("_i", own).withColumn("_j", F.explode(line("_across"))).drop(*of_grid)
        met = (dealt.filter("_meets").withColumn("_rj", F.pmod("_at", F.col("_across")).cast("int"))
               .withColumn("_ri", F.explode(line("_down"))).drop(*of_grid))
        in_grid = many.join(met, on & (F.col("_i") == F.col("_ri")) & (F.col("_j") == F.col("_rj"))).select(*columns)
    other = placed.filter("_meets IS NULL OR NOT _meets").withColumn("_i", own).drop(*of_grid)
    plain = dealt.filter("_meets IS NULL").withColumn("_ri", F.lit(0)).drop(*of_grid)
    return in_grid.unionByName(other.join(plain, on & (F.col("_i") == F.col("_ri")), "left").select(*columns))


def _grids(busy: DataFrame, limit: int) -> DataFrame:
    """(gkey, meets, across, down): the grid of each key."""
    left, right = F.col("_nl"), F.greatest("_nr", F.lit(1))
    cells = F.ceil(left * right / F.lit(float(limit)))
    across = F.least(F.greatest(F.ceil(F.sqrt(cells * F.col("_nr") / left)), F.lit(1)), right,
                     F.ceil((left + right) / left) * COPIES)
    down = F.when(F.col("_nr") > 0, F.least(F.ceil(cells / across), F.ceil((left + right) / right) * COPIES)).otherwise(cells)
    return busy.select(F.col("_key").alias("_gkey"), (F.col("_nr") > 0).alias("_meets"), across.cast("int").alias("_across"), down.cast("int").alias("_down"))


def _held(busy: DataFrame, rows: DataFrame) -> bool:
    """Whether a task can hold the right rows of all keys with a grid."""
    if int(busy.agg(F.sum("_nr")).first()[0] or 0) > HELD_ROWS:
        return False
    chars = F.octet_length(F.to_json(F.struct(*[quoted(c) for c in rows.columns])))
    return int(rows.agg(F.sum(chars)).first()[0] or 0) <= HELD_CHARS


def _both_counts(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(key, nl, nr): rows of each key of the left side on both sides, null among the keys."""
    mine = left.groupBy(quoted(left_key).alias("_key")).agg(F.count(F.lit(1)).alias("_nl"))
    theirs = right.groupBy(quoted(right_key).alias("_rkey")).agg(F.count(F.lit(1)).alias("_r"))
    return mine.join(theirs, F.col("_key").eqNullSafe(F.col("_rkey")), "left").select("_key", "_nl", F.coalesce("_r", F.lit(0)).alias("_nr"))
