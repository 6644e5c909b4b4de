import pytest
from pyspark.sql import functions as F

from joingrove.llm import queries, shards


def check(rows, n_shards, total, largest):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(n_shards))
    sizes = []
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sizes.append(sum(r["size"] for r in own))
    assert sum(sizes) == total
    if total >= n_shards * largest * 2:
        assert len(by) == n_shards and max(sizes) - min(sizes) < 2 * largest


@pytest.mark.parametrize("ranges, draws", [(4, 2), (64, 8), (512, 16)])
def test_sizes_near_equal_with_a_hot_key(spark, ranges, draws):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"),
                                    F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("doc_id"),
                                    (F.col("id") % 50 + 1).alias("size"), F.lit("x").alias("shards"))
    rows = shards.shard_by_size(docs, "size", ["k", "doc_id"], 16, ranges, draws).collect()
    check(rows, 16, sum(i % 50 + 1 for i in range(4000)), 50)
    assert len(rows) == 4000


def test_all_rows_equal(spark):
    docs = spark.range(1000).select(F.lit(1).alias("k"), F.lit(3).cast("long").alias("size"))
    check(shards.shard_by_size(docs, "size", ["k"], 16, 32, 4).collect(), 16, 3000, 3)


def test_one_huge_record_and_nulls(spark):
    docs = spark.createDataFrame([(None, 1), (1, 1_000_000), (2, 1), (None, 1)], "k long, size long")
    check(shards.shard_by_size(docs, "size", ["k"], 4, 8, 2).collect(), 4, 1_000_003, 1_000_000)


def test_empty(spark):
    docs = spark.createDataFrame([], "k long, size long")
    got = shards.shard_by_size(docs, "size", ["k"], 4)
    assert got.count() == 0 and got.columns == ["k", "size", "shard", "slot"]


def test_equal_keys_stand_together(spark):
    docs = spark.range(2000).select((F.col("id") % 100).alias("k"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("size"))
    rows = shards.shard_by_size(docs, "size", ["k", "doc_id"], 4).collect()
    order = [r["k"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_sampled_splitters(spark, sf).collect()
    sizes = {i: len((t or "").encode()) + 1 for i, t in docs.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    check(rows, 16, sum(sizes.values()), max(sizes.values()))
    import zlib
    assert all(r["text_crc32"] == zlib.crc32((docs[r["doc_id"]] or "").encode()) for r in rows)


def test_written_shards(spark, tmp_path):
    docs = spark.range(300).select("id", F.lit(1).cast("long").alias("size"))
    placed = shards.shard_by_size(docs, "size", ["id"], 3)
    shards.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("id", "shard", "slot").collect())) == sorted(map(tuple, placed.select("id", "shard", "slot").collect()))
