"""Joins to a lookup where some keys hold far more rows than others."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key with more than 1 / HOT_KEYS of all rows counts as hot, so there are fewer than HOT_KEYS of them.
HOT_KEYS = 1000


def join_spread(rows: DataFrame, lookup: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join to `lookup`, one row per key with the number of its rows in `weight`.

    Fewer than HOT_KEYS hot keys are broadcast, so no task gathers the rows of one; the others are
    shuffled. `rows` is read twice and should be written before.
    """
    hot = F.col(weight) > max(total // HOT_KEYS, 1)
    values = [c for c in lookup.columns if c != weight]
    few, many = lookup.filter(hot).select(values), lookup.filter(~hot).select(values)
    spread = rows.join(F.broadcast(few), on)
    return spread.unionByName(rows.join(F.broadcast(few.select(on)), on, "left_anti").join(many, on))
