"""Shards of nearly equal size by sampled splitters.

Size-weighted samples of a key give quantile boundaries, records fall into the ranges between them,
ranges that came out overfull are subdivided by further samples of their own, and exact totals per
range place every record: its shard is where its first byte lies on the line of all bytes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from joingrove.llm.common import map_batches, stage
from joingrove.sources.staging import stage_observed

#: Ranges that the boundaries aim at, and draws per range. Their product bounds what the driver sees.
RANGES, DRAWS = 512, 16
#: A range with more than OVERFULL times its aim is subdivided; so many times at most.
OVERFULL, ROUNDS = 2.0, 4
_SPAN = float(1 << 53)


def size_of(text_col: str = "text"):
    """UTF-8 bytes plus one; a null text has none."""
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")


def shard_by_size(records: DataFrame, size_col: str, key_cols: list[str], shards: int = 16,
                  ranges: int = RANGES, draws: int = DRAWS) -> DataFrame:
    """`records` with shard (0 to shards - 1) and slot (its place there, from 0 without gaps).

    key_cols are integer columns, nulls first; rows equal in all of them are told apart by a number
    given when the records are written, so one key may hold any share of the rows. The bytes of any
    two shards differ by less than two records. Rows of equal keys stand together wherever a shard
    boundary does not pass between them. An empty table gives no row; sizes must be positive.
    `records` should be light (keys and sizes, not texts): it is written once and read a few times.
    Names that start with an underscore are kept for this function.
    """
    spark = records.sparkSession
    names = records.columns
    base, seen = stage_observed(records.withColumn("_row", F.monotonically_increasing_id()), "shard-records",
                                F.sum(F.col(size_col)).alias("bytes"))
    total = int(seen["bytes"] or 0)
    if total == 0:
        return base.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    key = [F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63))).alias(f"_k{i}") for i, c in enumerate(key_cols)]
    base = base.select("*", *key)
    order = [f"_k{i}" for i in range(len(key))] + ["_row"]

    splitters = _splitters(base, order, size_col, total, ranges, draws)
    ranged = stage(_with_range(base, order, splitters), "shard-ranges")
    sums = {r["_range"]: (r["bytes"], r["n"]) for r in ranged.groupBy("_range")
            .agg(F.sum(size_col).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    starts, at, row = [], 0, 0
    for i in sorted(sums):  # one entry a range, so bounded by the splitters
        starts.append((i, at, row))
        at, row = at + sums[i][0], row + sums[i][1]

    start = spark.createDataFrame(starts, "_range int, _at long, _before long")
    line = W.partitionBy("_range").orderBy(*order)
    before = F.coalesce(F.sum(size_col).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_at")
    placed = (ranged.join(F.broadcast(start), "_range")
              .select(*names, F.floor(before * F.lit(shards) / F.lit(total)).cast("int").alias("shard"),
                      (F.row_number().over(line) - 1 + F.col("_before")).alias("_index")))
    placed = stage(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # a row a shard
    return (placed.join(F.broadcast(first), "shard")
            .select(*names, "shard", (F.col("_index") - F.col("_first")).alias("slot")))


def _draw(order: list[str], size_col: str, aim: float, seed: int):
    """True for a record with probability size / aim, the same each time it is asked."""
    u = F.xxhash64(F.lit(seed), *order).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(_SPAN)
    return u < F.col(size_col) / F.lit(float(aim))


def _splitters(base: DataFrame, order: list[str], size_col: str, total: int, ranges: int, draws: int) -> list[tuple]:
    """Quantile boundaries of size-weighted draws; overfull ranges are drawn from again, more finely."""
    aim = total / ranges
    drawn = base.where(_draw(order, size_col, aim / draws, 0)).select(*order).collect()
    keys = sorted(tuple(r) for r in drawn)
    splitters = sorted(set(keys[draws::draws]))
    for seed in range(1, ROUNDS + 1):
        ranged = _with_range(base, order, splitters)
        over = [(r["_range"], r["bytes"]) for r in ranged.groupBy("_range")
                .agg(F.sum(size_col).alias("bytes"), F.count(F.lit(1)).alias("n"))
                .where((F.col("bytes") > OVERFULL * aim) & (F.col("n") > 1)).collect()]
        if not over:
            break
        into = base.sparkSession.createDataFrame([(i,) for i, _ in over], "_range int")
        more = (ranged.join(F.broadcast(into), "_range").where(_draw(order, size_col, aim / draws, seed))
                .select("_range", *order).collect())
        own: dict[int, list[tuple]] = {}
        for r in more:
            own.setdefault(r["_range"], []).append(tuple(r)[1:])
        fresh = {k for ks in own.values() for k in sorted(ks)[draws // 2::draws]}
        if fresh <= set(splitters):
            break
        splitters = sorted(set(splitters) | fresh)
    return splitters


def _with_range(base: DataFrame, order: list[str], splitters: list[tuple]) -> DataFrame:
    """_range: the number of splitters up to the record, found by bisection in its task."""
    names = base.columns

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for columns in batches:
            out = dict(zip(names, columns))
            out["_range"] = [bisect_right(splitters, k) for k in zip(*(out[c] for c in order))]
            yield out

    schema = T.StructType([*base.schema.fields, T.StructField("_range", T.IntegerType())])
    return map_batches(base, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))


def write_shards(records: DataFrame, path: str) -> None:
    """One folder a shard; its files are consecutive runs of slots, as many as Spark has shuffle partitions."""
    (records.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
