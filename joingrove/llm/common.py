"""What the operators share: tables, row keys, staging and joins that survive hot keys."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joingrove.sources.staging import stage

#: A key with more than 1 / HOT_SHARE of all rows counts as hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Where no key has more rows than this, none is treated as hot, whatever its share: any task can take them.
FEW = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, under names of their own; a null text is empty.

    Whatever other columns `docs` has is dropped here, so none can clash.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_key() -> Column:
    """With doc_id it identifies a row up to rows that are equal in both."""
    return F.xxhash64("text")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, rows_per_key: str, total: int, most: int | None = None) -> DataFrame:
    """Inner join of `rows` with `lookup`, which has one row a key and its number of rows in `rows_per_key`.

    The at most HOT_SHARE keys with the most rows are broadcast, so the rows of none of them meet in
    one task; all others are shuffled. Both frames should be staged: `rows` is read twice. Where `most`, the rows of
    the key that has most or a bound of them, shows that no key is hot, this is one plain join.
    """
    hot_above = max(total // HOT_SHARE, 1)
    values = [c for c in lookup.columns if c != rows_per_key]
    if most is not None and most <= max(hot_above, FEW):
        return rows.join(lookup.select(values), key)
    hot = lookup.where(F.col(rows_per_key) > hot_above).select(values)
    cold = lookup.where(F.col(rows_per_key) <= hot_above).select(values)
    of_hot = rows.join(F.broadcast(hot), key)
    of_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return of_hot.unionByName(of_cold)


def join_copies(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, total: int, most: int | None = None) -> DataFrame:
    """Inner join of `rows` with `lookup`, which has one row a key; `counts` has `key` and n, the rows of each key.

    A key with more than total / HOT_SHARE of the `total` rows is dealt over as many copies of its lookup row as keep each
    below that; there are at most 2 * HOT_SHARE copies, and only keys are broadcast, so lookup rows may be of any size. Where
    `most`, the rows of the key that has most or a bound of them, shows that no key is hot, this is one plain join.
    """
    share = max(total // HOT_SHARE, 1)
    if most is not None and most <= max(share, FEW):
        return rows.join(lookup, key)
    hot = F.broadcast(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("__copies")))
    copies, others = F.coalesce("__copies", F.lit(1)), [c for c in rows.columns if c != key]
    dealt = (rows.join(hot, key, "left").withColumn("__copy", F.pmod(F.xxhash64(key, *others), copies).cast("int")).drop("__copies"))
    copied = lookup.join(hot, key, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return dealt.join(copied, [key, "__copy"]).drop("__copy")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless they find it by PYTHONPATH."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, name))


_shipped: set[str] = set()


def map_batches(df: DataFrame, fn: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for a function from an iterator of column lists to dictionaries of column lists.

    `fn` gets an iterator of tuples, one Python list for each column of `df`.
    """
    spark = df.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], schema)
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in empty.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (tuple(c.to_pylist() for c in b.columns) for b in batches)
        for out in fn(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
            "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]


__all__ = ["HOT_SHARE", "held_out", "join_copies", "join_hot", "map_batches", "ship", "stage", "table", "text_key", "texts"]
