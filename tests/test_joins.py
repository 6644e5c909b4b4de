import pytest
from pyspark.sql import functions as F

from joingrove.operators import joins as J


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame(
        [(1, "b", 2.0), (1, "a", 9.0), (2, None, 1.0), (2, "a", 0.0), (None, "z", 0.0), (3, "c", None)],
        "k long, s string, v double")


def test_one_row_per_key_takes_the_least_row(right):
    rows = {r["k"]: (r["s"], r["v"]) for r in J.one_row_per_key(right, "k").collect()}
    assert rows == {1: ("a", 9.0), 2: (None, 1.0), 3: ("c", None)}


def test_one_row_per_key_with_seed_is_repeatable(right):
    a = sorted(map(tuple, J.one_row_per_key(right, "k", seed=42).collect()))
    b = sorted(map(tuple, J.one_row_per_key(right.repartition(7), "k", seed=42).collect()))
    assert a == b and len(a) == 3


def test_a_join_nobody_reads_is_dropped(spark, right):
    left = spark.range(5).withColumnRenamed("id", "lk")
    joined = J.left_join_one(left, "lk", J.one_row_per_key(right, "k"), "k").select("lk")
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()


def skewed(spark):
    """A third of the rows on one key, a third without."""
    return spark.range(900).selectExpr(
        "id AS _rid", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE id END AS lk")


def test_hot_keys_are_spread_and_rows_kept(spark, right):
    left = skewed(spark)
    one = J.one_row_per_key(right, "k")
    summary = J.key_summary(J.key_counts(left, "lk"), left.count(), right, "k")
    assert set(summary.hot) == {1, None}
    plain = J.left_join_one(left, "lk", one, "k")
    spread = J.left_join_one(left, "lk", one, "k", list(summary.hot))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(plain) == key(spread) and plain.count() == 900


def test_hot_keys_are_bounded(spark):
    left = spark.range(20000).selectExpr("id AS _rid", "id % 7000 AS lk")
    summary = J.key_summary(J.key_counts(left, "lk"), 20000, left.withColumnRenamed("lk", "k"), "k")
    assert len(summary.hot) <= 1 / J.HOT_SHARE and summary.ratio == 1.0


def _summary(left, right):
    return J.key_summary(J.key_counts(left, "lk"), left.count(), right, "k")


def test_ratio_counts_rows_not_keys(spark, right):
    left = spark.createDataFrame([(1,), (1,), (9,), (None,)], "lk long")
    assert _summary(left, right).ratio == 0.5


def test_exactly_half_passes_and_empty_does_not(spark, right):
    left = spark.createDataFrame([(1,), (2,), (8,), (9,)], "lk long")
    assert _summary(left, right).passes(0.5)
    assert not _summary(left.limit(0), right).passes(0.5)


def test_fan_out_join_matches_null_to_null(spark, right):
    left = spark.createDataFrame([(1,), (None,)], "lk long")
    assert J.left_join_all(left, "lk", right, "k").count() == 3


def test_families_decide_joinability(spark):
    df = spark.range(1).selectExpr("cast(1 AS int) AS i", "1L AS l", "1D AS d", "'1' AS s", "array(1) AS a")
    assert J.joinable(df, "i", df, "l")
    assert not J.joinable(df, "i", df, "d") and not J.joinable(df, "l", df, "s")
    assert not J.joinable(df, "a", df, "a")


@pytest.mark.parametrize("parts", [1, 5])
def test_result_does_not_depend_on_partitions(spark, right, parts):
    got = sorted(map(str, J.one_row_per_key(right.repartition(parts), "k").collect()))
    assert got == sorted(map(str, J.one_row_per_key(right, "k").collect()))


@pytest.mark.parametrize("limit", [50, 1000, 10 ** 9])
def test_rows_fan_out_over_hot_keys_on_both_sides(spark, tmp_path, limit):
    """A key and null hold a third of both sides each; another key is hot on the left and has no partner."""
    def side(name, n, rest, lone):
        rows = [(i, 7 if i % 3 == 0 else None if i % 3 == 1 else rest + i if i % 2 else lone) for i in range(n)]
        spark.createDataFrame(rows, f"{name}_id long, {name}_k long").repartition(3).write.parquet(str(tmp_path / name))
        return rows, spark.read.parquet(str(tmp_path / name))

    mine, left = side("l", 240, 1000, 99)
    theirs, right = side("r", 180, 1003, 98)
    joined = J.left_join_all(left, "l_k", right, "r_k", limit)
    assert joined.columns == left.columns + right.columns
    want = sorted(((a, b) for a, k in mine for b in ([r for r, q in theirs if q == k] or [None])), key=repr)
    assert sorted(((r["l_id"], r["r_id"]) for r in joined.collect()), key=repr) == want


def test_no_task_makes_more_pairs_than_a_cell_of_the_grid(spark, tmp_path):
    spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE id END AS k").write.parquet(str(tmp_path / "l"))
    spark.range(3000).selectExpr("id AS x", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE -id END AS j").write.parquet(str(tmp_path / "r"))
    left, right = spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r"))
    with_parts = lambda d: d.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.sum("count")).first()
    parts, adaptive = (spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        largest, rows = with_parts(J.left_join_all(left, "k", right, "j", 20_000))
        whole, same = with_parts(J.left_join_all(left, "k", right, "j", 10 ** 9))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == same == 2_001_000
    assert whole >= 1_000_000 and largest < 160_000  # a handful of cells at most


def hot_sides(spark, tmp_path):
    """Two keys and null are hot on both sides, one key is only on the left."""
    mine = [(i, [5, None, 6, 90 + i % 2][i % 4]) for i in range(200)]
    theirs = [(i, [6, 5, None, 91][i % 4]) for i in range(120)] + [(500, None)]
    spark.createDataFrame(mine, "l_id long, l_k long").repartition(3).write.parquet(str(tmp_path / "l"))
    spark.createDataFrame(theirs, "r_id long, r_k long").repartition(2).write.parquet(str(tmp_path / "r"))
    want = sorted(((a, b) for a, k in mine for b in ([r for r, q in theirs if q == k] or [None])), key=repr)
    return spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r")), want


def test_few_right_rows_of_hot_keys_are_held_and_no_row_is_copied(spark, tmp_path):
    left, right, want = hot_sides(spark, tmp_path)
    joined = J.left_join_all(left, "l_k", right, "r_k", 20)
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(((r["l_id"], r["r_id"]) for r in joined.collect()), key=repr) == want


@pytest.mark.parametrize("limits", [{"HELD_ROWS": 0}, {"HELD_CHARS": 0}, {"HELD_ROWS": 0, "COPIES": 1}])
def test_many_right_rows_of_hot_keys_meet_in_a_grid(spark, tmp_path, monkeypatch, limits):
    left, right, want = hot_sides(spark, tmp_path)
    for name, value in limits.items():
        monkeypatch.setattr(J, name, value)
    joined = J.left_join_all(left, "l_k", right, "r_k", 20)
    assert "Generate" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(((r["l_id"], r["r_id"]) for r in joined.collect()), key=repr) == want


def test_copies_of_a_grid_stay_in_proportion_to_the_rows(spark):
    sides = [(1, 1_800_000, 120_000), (2, 120_000, 1_800_000), (3, 50_000, 50_000), (4, 900_000, 2), (5, 900_000, 0)]
    grids = {r["_gkey"]: r for r in J._grids(spark.createDataFrame(sides, "_key long, _nl long, _nr long"), 1000).collect()}
    for key, left, right in sides[:4]:
        g = grids[key]
        assert g["_meets"] and left * g["_across"] + right * g["_down"] <= 4 * J.COPIES * (left + right)
    assert not grids[5]["_meets"] and grids[5]["_across"] == 1 and grids[5]["_down"] == 900
