import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from joingrove.functions import stats
from joingrove.streaming.hop import best_features, mean_score
from joingrove.functions.prepare import category_codes, category_counts
from joingrove.functions.prepare import Range, bin_sql, binary_target, prepare
from joingrove.operators import selection as S


@pytest.fixture(scope="module")
def planted(spark):
    """Signal, copy, noise, constant, leak and nulls beside a 0/1 target."""
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        y = rnd.randint(0, 1)
        signal = y * 1.5 + rnd.random()
        rows.append((i, y, signal, signal * 2 + 1, rnd.random(), 3.0, y * 5,
                     None if i % 3 == 0 else signal + rnd.random()))
    return spark.createDataFrame(
        rows, "_rid long, y int, x_signal double, x_copy double, x_noise double, x_const double, "
              "x_leak int, x_null double").cache()


FEATURES = ["x_signal", "x_copy", "x_noise", "x_const", "x_leak", "x_null"]


def scores(df):
    return {r["feature"]: r["score"] for r in df.collect()}


def average_rank(values):
    order = sorted(values)
    return [(2 * order.index(v) + order.count(v) + 1) / 2 for v in values]


def pairs(planted, feature, target="y"):
    rows = [(r[feature], r[target]) for r in planted.collect()]
    return [(x, y) for x, y in rows if x is not None and y is not None]


def corr(x, y):
    return 0.0 if min(x) == max(x) or min(y) == max(y) else float(np.corrcoef(x, y)[0, 1])


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (None,)], "v double")
    ranks = {r["value"]: r["rank"] for r in stats.rank_columns(df, ["v"]).collect()}
    assert ranks == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_ranks_do_not_depend_on_ranges(planted, chunk):
    plain = {tuple(r) for r in stats.rank_columns(planted, FEATURES).collect()}
    cut = {tuple(r) for r in stats.rank_columns(planted, FEATURES, chunk_rows=chunk).collect()}
    assert plain == cut


def test_correlations_against_numpy(planted):
    pearson = scores(stats.pearson(planted, FEATURES, "y"))
    binary = scores(stats.spearman_binary(planted, FEATURES, "y"))
    general = scores(stats.spearman(planted, FEATURES, "y"))
    cut = scores(stats.spearman(planted, FEATURES, "x_noise", chunk_rows=50))
    for f in FEATURES:
        x, y = zip(*pairs(planted, f))
        assert pearson[f] == pytest.approx(corr(x, y), abs=1e-9)
        ranked = corr(average_rank(x), average_rank(y))
        assert binary[f] == pytest.approx(ranked, abs=1e-9)
        assert general[f] == pytest.approx(ranked, abs=1e-9)
        x, y = zip(*pairs(planted, f, "x_noise"))
        assert cut[f] == pytest.approx(corr(average_rank(x), average_rank(y)), abs=1e-9)


def test_rank_correlation_needs_two_rows(spark):
    with pytest.raises(ValueError):
        stats.spearman(spark.createDataFrame([(1.0, 1)], "x double, y int"), ["x"], "y")


def test_relevance_drops_constant_and_leak(planted):
    kept = {r["feature"]: r["selected"] for r in S.measure_relevance(planted, FEATURES + ["y"], "y").collect()}
    assert kept["x_signal"] and not kept["x_const"] and not kept["x_leak"] and "y" not in kept


def test_relevance_of_nothing(planted):
    assert S.measure_relevance(planted, ["absent"], "y").collect() == []


def test_value_counts_with_weights_equal_rows(planted):
    rows = planted.selectExpr("*", "round(x_noise, 1) AS r")
    direct = scores(stats.spearman_of_counts(stats.value_counts(rows, ["r"], "y")))
    folded = rows.groupBy("r").agg(F.count("*").alias("_n"), F.sum("y").alias("_s"))
    weighed = scores(stats.spearman_of_counts(
        stats.value_counts(folded, ["r"], weight="_n", target_sum="_s")))
    assert direct["r"] == pytest.approx(weighed["r"], abs=1e-12)


def entropy(rows):
    n = len(rows)
    return -sum(c / n * math.log(c / n) for c in (rows.count(v) for v in set(rows)))


def test_information_against_counting(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randint(0, 2), rnd.choice([None, 1, 2])) for _ in range(120)]
    df = spark.createDataFrame(rows, "x string, y int, z int")
    plan = stats.EntropyPlan()
    found = scores(plan.evaluate(df, [
        ("h", plan.h("x")), ("mi", plan.mutual("x", "y")), ("im", plan.mutual("y", "x")),
        ("ce", plan.conditional_entropy("x", "y")), ("cmi", plan.conditional_mutual("x", "y", "z"))]))
    x, y, z = ([r[i] for r in rows] for i in range(3))
    j = lambda *c: entropy(list(zip(*c)))
    assert found["h"] == pytest.approx(entropy(x))
    assert found["mi"] == pytest.approx(entropy(x) + entropy(y) - j(x, y), abs=1e-9)
    assert found["mi"] == pytest.approx(found["im"]) and found["mi"] >= -1e-12
    assert found["ce"] == pytest.approx(j(x, y) - entropy(x), abs=1e-9)
    assert found["cmi"] == pytest.approx(j(x, z) + j(y, z) - j(x, y, z) - entropy(z), abs=1e-9)


def test_codes_and_values_give_the_same_entropy(spark):
    df = spark.range(500).selectExpr("cast(id % 5 AS int) AS a", "cast(id % 7 AS int) AS b", "cast(id % 2 AS int) AS c")
    sets = [("a",), ("a", "b"), ("a", "b", "c")]
    plain = {r["set_id"]: r["h"] for r in stats.entropies(df, sets).collect()}
    coded = {r["set_id"]: r["h"] for r in stats.entropies_of_codes(df, sets).collect()}
    assert plain == pytest.approx(coded)


def test_large_integers_stay_apart(spark):
    big = 2 ** 60
    df = spark.createDataFrame([(big,), (big + 1,)], "x long")
    assert stats.entropies(df, [("x",)]).first()["h"] == pytest.approx(math.log(2))


@pytest.mark.parametrize("value,code", [("NULL", 0), ("0D", 1), ("1.99D", 1), ("2D", 2), ("10D", 5), ("9.99D", 5)])
def test_bins(spark, value, code):
    got = spark.sql(f"SELECT {bin_sql('v', Range(0.0, 10.0))} AS b FROM (SELECT cast({value} AS double) AS v)")
    assert got.first()["b"] == code


def test_constant_is_bin_one(spark):
    assert spark.sql(f"SELECT {bin_sql('v', Range(3.0, 3.0))} AS b FROM (SELECT 3D AS v)").first()["b"] == 1


def normalised(spark, rows):
    df = spark.createDataFrame(rows, "feature string, score double")
    return {r["feature"]: (r["score"], r["selected"]) for r in S.normalise(df).collect()}


def test_normalise(spark):
    got = normalised(spark, [("a", 0.30), ("b", 0.10), ("c", 0.20)])
    assert got["a"] == (1.0, True) and got["b"] == (0.0, False)
    assert got["c"][0] == pytest.approx(0.5) and got["c"][1]
    assert normalised(spark, [("a", 0.0), ("b", 0.0)]) == {}
    assert normalised(spark, [("a", 0.4), ("b", 0.4)]) == {"a": (0.0, False), "b": (0.0, False)}
    assert normalised(spark, [("a", 0.4)]) == {"a": (0.0, False)}


def test_worked_tree_score():
    rel = (("a", 0.5), ("b", 0.4), ("c", 0.3))
    assert mean_score(rel, (("a", 1.0), ("c", 0.5))) == pytest.approx(1.15)


def test_best_features_break_ties_by_name():
    found = best_features([("b", -0.5, 0, 1), ("a", 0.5 + 1e-15, 0, 1), ("one", 1.0, 0, 1), ("flat", 0.4, 2, 2), ("c", 0.1, 0, 1)], 2)
    assert [f for f, _, _ in found.top] == ["a", "b"] and [f for f, _ in found.rest] == ["one", "c"]


def test_mrmr_without_selected_is_mutual_information(planted):
    got = scores(S.mrmr(planted, ["x_signal", "x_noise"], [], "y"))
    assert got["x_signal"] > got["x_noise"] >= -1e-12


def test_copy_of_a_selected_feature_scores_lowest(planted):
    got = scores(S.mrmr(planted, ["x_copy", "x_null", "x_noise"], ["x_signal"], "y"))
    assert min(got, key=got.get) == "x_copy"


def test_group_of_one_is_unscored(planted):
    assert S.measure_group_redundancy(planted, ["x_noise"], "y").collect()[0]["score"] is None


def test_prepare_drops_and_codes(spark):
    df = spark.createDataFrame(
        [(1, "b", True, 5, None), (2, "a", False, 5, None), (3, None, True, 5, None)],
        "id long, s string, f boolean, c int, n double")
    ready, limits = prepare(df, ["s", "f", "c", "n"], ["id"])
    assert set(limits) == {"s", "f"}
    assert {r["id"]: (r["s"], r["f"]) for r in ready.collect()} == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (None, 1.0)}


@pytest.mark.parametrize("labels", [0, 10_000])
def test_any_number_of_labels_is_coded(spark, monkeypatch, labels):
    """By broadcast and by a shuffle with hot and missing labels; texts of any length."""
    monkeypatch.setattr("joingrove.functions.prepare.BROADCAST_LABELS", labels)
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN null ELSE "
                                      "concat(repeat('x', 300), lpad(id, 5, '0')) END AS s", "cast(id % 3 AS string) AS t")
    ready, limits = prepare(df, ["s", "t"], ["id"])
    want = sorted({r["s"] for r in df.collect()} - {None})
    assert limits["s"].high == len(want) - 1 and limits["t"].high == 2
    got = {r["id"]: r["s"] for r in ready.collect()}
    assert got == {r["id"]: None if r["s"] is None else float(want.index(r["s"])) for r in df.collect()}


def test_codes_over_ranges(spark):
    df = spark.range(500).selectExpr("concat('v', id % 100) AS s", "1 AS one")
    counts = category_counts(df, ["s"])
    got = {r["label"]: r["code"] for r in category_codes(counts, 10 ** 9, chunk_rows=7).collect()}
    assert got == {v: float(i) for i, v in enumerate(sorted({f"v{i}" for i in range(100)}))}


def test_days_in_strings_become_times(spark):
    df = spark.createDataFrame([(1, "2024-01-31", "2024-01-31 x"), (2, "2024-02-01 10:00:00", "b"), (3, None, "c")], "id int, d string, s string")
    _, limits = prepare(df, ["d", "s"], ["id"])
    assert "d__month" in limits and "s__month" not in limits and limits["s"].high == 2


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0, 0), (float("nan"), 1), (2.0, 1)], "x double, y int")
    assert scores(stats.spearman_binary(df, ["x"], "y"))["x"] == pytest.approx(1.0)


def test_target_must_have_two_values(spark):
    good = spark.createDataFrame([("good",), ("bad",), (None,)], "t string")
    assert [r[0] for r in good.select(binary_target(good, "t")).collect()] == [1, 0, None]
    with pytest.raises(ValueError):
        binary_target(spark.range(3).selectExpr("id AS t"), "t")


def test_counts_of_a_set_are_summed_from_a_wider_one(spark):
    """Triples, pairs within and without a triple, and single columns, all from one pass over the rows."""
    rng = random.Random(9)
    rows = [tuple(rng.choice([None, "a", "b", "c"][:k]) for k in (2, 3, 4, 4, 3)) for _ in range(400)]
    names = ["p", "q", "r", "s", "t"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    sets = [("p",), ("p", "q"), ("p", "q", "r"), ("q", "r"), ("s", "t"), ("t",), ("r",), ("s", "p", "r"), ("q",)]
    assert stats._containing(sets) == [1, 2, None, 2, None, 4, 3, None, 1]

    def entropy(columns):
        counts = Counter(tuple(r[names.index(c)] for c in columns) for r in rows)
        return -sum(n / 400 * math.log(n / 400) for n in counts.values())

    got = {r["set_id"]: r["h"] for r in stats.entropies(df, sets).collect()}
    assert got == {k: pytest.approx(entropy(s)) for k, s in enumerate(sets)}
    coded = df.selectExpr(*[f"coalesce(ascii({n}) - 96, 0) AS {n}" for n in names])
    assert {r["set_id"]: r["h"] for r in stats.entropies_of_codes(coded, sets).collect()} == {k: pytest.approx(entropy(s)) for k, s in enumerate(sets)}


def test_rows_spread_to_no_more_cells_when_inner_sets_are_asked_for(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS a", "id % 5 AS b", "id % 3 AS c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    inner = [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c")]
    spread = lambda sets: sum(above is None for above in stats._containing(sets))
    assert spread([("a", "b", "c")]) == spread([("a", "b", "c"), *inner]) == 1 and spread(inner) == 3
    assert stats.entropies(df, [("a", "b", "c"), *inner]).count() == 7
