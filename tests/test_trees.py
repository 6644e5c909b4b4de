import random

import pytest
from pyspark.sql import functions as F

from joingrove import Augmenter
from joingrove.operators import curate
from joingrove.operators.edges import both_directions
from joingrove.operators.models import algorithms
from joingrove.plans import jointree as JT
from joingrove.schemas import EDGES, FEATURE_SCORES
from joingrove.sources.catalog import Catalog
from joingrove.streaming.hop import Options

ROWS = 300


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    """base -> good -> deep, base -> half (every other key), base -> rare (few keys)."""
    root = tmp_path_factory.mktemp("tables")
    rnd = random.Random(5)
    y = [rnd.randint(0, 1) for _ in range(ROWS)]
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(root / f"{name}.parquet"))
    save("base", [(i, i, rnd.random(), "yes" if y[i] else "no") for i in range(ROWS)],
         "id long, k long, own double, label string")
    save("good", [(i, y[i] * 2 + rnd.random(), rnd.random(), i % 40, 7) for i in range(ROWS) for _ in range(2)],
         "gk long, signal double, noise double, dk long, fixed int")
    save("deep", [(i, rnd.random(), rnd.choice("pqr")) for i in range(40)], "dk long, u double, w string")
    save("half", [(i, rnd.random(), rnd.random()) for i in range(0, ROWS, 2)], "hk long, a double, b double")
    save("rare", [(i, rnd.random(), rnd.random()) for i in range(10)], "rk long, a double, b double")
    save("text", [(str(i), rnd.random(), rnd.random()) for i in range(ROWS)], "tk string, a double, b double")
    return Catalog.from_parquet_dir(spark, str(root), ["base", "good", "deep", "half", "rare", "text"])


def augmenter(spark, catalog, links, **options):
    a = Augmenter(spark, catalog=catalog, options=Options(**options))
    a.set_base_table("base", "label", row_key="id")
    a.set_relationships(both_directions(spark.createDataFrame(links, EDGES)))
    return a


LINKS = [("base", "good", "k", "gk", 0.9), ("good", "deep", "dk", "dk", 0.8),
         ("base", "half", "k", "hk", 0.8), ("base", "rare", "k", "rk", 0.7),
         ("rare", "text", "rk", "tk", 0.9)]


@pytest.fixture(scope="module")
def grown(spark, catalog):
    a = augmenter(spark, catalog, LINKS)
    a.compute_join_trees()
    return a


def test_growth_order_and_pruning(grown):
    joins = [r["to_table"] for r in grown.tree_joins.filter("tree_id = 3").orderBy("join_idx").collect()]
    assert joins == ["good", "half", "deep"]
    assert [e.to_table for e, _ in grown.search.pruned] == ["rare"]
    assert grown.search.pruned[0][1] == pytest.approx(10 / ROWS)
    ratios = {r["to_table"]: r["non_null_ratio"] for r in grown.tree_joins.collect()}
    assert ratios["half"] == 0.5 and ratios["good"] == 1.0


def test_tables_behind_a_pruned_one_are_not_reached(grown):
    assert grown.tree_joins.filter("to_table = 'text'").count() == 0


def test_trees_are_prefixes_of_one_another(grown):
    features = [r["features"] for r in grown.trees.orderBy("tree_id").collect()]
    for a, b in zip(features, features[1:]):
        assert b[:len(a)] == a and len(b) > len(a)
    assert features[0] == ["base__id", "base__k", "base__own"]


def test_signal_is_kept_and_constant_is_not_scored(grown):
    assert "good__signal" in grown.get_tree_by_id(1).first()["features"]
    assert grown.feature_scores.filter("feature = 'good__fixed'").count() == 0


def test_rank_is_the_score_of_the_last_join(grown):
    for tree in grown.search.trees[1:]:
        hop = tree.joins[-1].hop
        assert tree.rank == pytest.approx(sum(v for _, v in hop.rel) / len(hop.rel) + sum(v for _, v in hop.red) / len(hop.red))


def test_edges_on_the_target_are_no_joins(grown):
    target = grown.target
    before = len(grown.search.trees)
    edges = grown.edges.unionByName(grown.spark.createDataFrame(
        [(grown.base_table, t, target, "k", 1.0) for t in grown.get_tables_repository() if t != grown.base_table],
        grown.edges.schema))
    assert len(JT.grow(grown.catalog, grown.base_table, target, grown.base_frame, edges, grown.options).trees) == before


def test_materialised_tree_keeps_base_rows(grown):
    df = grown.materialise_join_tree(3, include_target=True)
    assert df.count() == ROWS and df.columns[0] == "label"
    assert grown.materialise_join_tree(1, dedupe=False).count() == 2 * ROWS


def test_missing_tree(grown):
    assert grown.get_tree_by_id(99).count() == 0
    with pytest.raises(ValueError):
        grown.materialise_join_tree(99)


def test_type_mismatch_keeps_the_tree(spark, catalog):
    a = augmenter(spark, catalog, [("base", "text", "k", "tk", 0.9), ("base", "half", "k", "hk", 0.8)])
    a.compute_join_trees()
    assert {r["to_table"] for r in a.tree_joins.collect()} == {"half"}


def test_single_feature_is_a_bridge_that_later_joins_replay(spark, catalog):
    a = augmenter(spark, catalog, LINKS[:2], )
    a.compute_join_trees(top_k_features=1)
    assert a.trees.count() == 1
    kept = augmenter(spark, catalog, LINKS[:2], keep_single=True)
    kept.compute_join_trees(top_k_features=1)
    assert kept.trees.count() == 3


def test_bridge_is_recorded_and_replayed(spark, catalog, tmp_path):
    """A table with nothing but its key is walked through to the one behind it."""
    spark.range(ROWS).selectExpr("id AS bk").write.parquet(str(tmp_path / "bridge"))
    with_bridge = catalog.add("bridge", str(tmp_path / "bridge"))
    a = augmenter(spark, with_bridge, [("base", "bridge", "k", "bk", 0.9), ("bridge", "deep", "bk", "dk", 0.9)])
    a.compute_join_trees(non_null_threshold=0.1)
    assert {r["to_table"]: r["is_bridge"] for r in a.tree_joins.collect()} == {"bridge": True, "deep": False}
    assert a.materialise_join_tree(1).count() == ROWS
    assert "bridge__bk" not in a.get_tree_by_id(1).first()["features"]


def test_tied_keys_both_become_trees(spark, catalog):
    a = augmenter(spark, catalog, [("base", "good", "k", "gk", 0.9), ("base", "good", "id", "gk", 0.9)])
    a.compute_join_trees()
    assert {r["from_col"] for r in a.tree_joins.collect()} == {"k", "id"}
    assert a.trees.count() == 3


def test_edits_of_edges_are_followed(spark, catalog):
    a = augmenter(spark, catalog, LINKS[:1])
    a.compute_join_trees()
    assert a.trees.count() == 2
    a.add_relationship("base", "k", "half", "hk", 0.9)
    assert a.trees.count() == 3
    a.remove_relationship("half", "hk", "base", "k")
    assert a.trees.count() == 2


def test_excluded_table(spark, catalog):
    a = augmenter(spark, catalog, LINKS)
    a.remove_table("good")
    assert a.edges.filter("from_table = 'good' OR to_table = 'good'").count() == 0
    assert "good" not in a.get_tables_repository()


def test_removing_a_table_takes_its_descendants(grown):
    trees, joins, scores = JT.remove_table(grown.trees, grown.tree_joins, grown.feature_scores, 3, "good")
    assert [r["to_table"] for r in joins.filter("tree_id = 3").collect()] == ["half"]
    left = trees.filter("tree_id = 3").first()
    assert not any(f.startswith(("good__", "deep__")) for f in left["features"])
    assert left["join_keys"] == ["base__k", "half__hk"]
    assert trees.filter("tree_id = 2").first()["features"] == grown.get_tree_by_id(2).first()["features"]


def test_labels_of_nodes(grown):
    nodes = {(r["from_node"], r["to_node"]): r["label"] for r in grown.display_join_tree(3).collect()}
    assert nodes == {(0, 1): "k -> gk", (0, 2): "k -> hk", (1, 3): "dk -> dk"}


def test_result_does_not_depend_on_shuffle_partitions(spark, catalog, grown):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        a = augmenter(spark, catalog, LINKS[:1])
        a.compute_join_trees()
        one, many = a.get_tree_by_id(1).first(), grown.get_tree_by_id(1).first()
        assert one["features"] == many["features"] and one["rank"] == pytest.approx(many["rank"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_moving_features_back_and_forth(spark):
    scores = spark.createDataFrame(
        [(1, 0, f, k, 0.5, f != "c") for f in "abc" for k in ("rel", "red")], FEATURE_SCORES)
    trees = spark.createDataFrame([(1, ["a", "b"])], "tree_id int, features array<string>")
    less, changed = curate.move_to_discarded(trees, scores, 1, ["a"])
    assert less.first()["features"] == ["b"]
    assert changed.filter("feature = 'a' AND selected").count() == 0
    more, back = curate.move_to_selected(less, changed, 1, ["a"])
    assert more.first()["features"] == ["b", "a"] and back.filter("selected").count() == 4


def test_nulls_in_target_are_left_out(spark, catalog, tmp_path):
    spark.sql("SELECT id AS id, id AS k, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS label "
              f"FROM range({ROWS})").write.parquet(str(tmp_path / "n"))
    a = Augmenter(spark, catalog=catalog.add("n", str(tmp_path / "n")))
    a.set_base_table("n", "label", row_key="id")
    a.set_relationships(both_directions(spark.createDataFrame([("n", "good", "k", "gk", 0.9)], EDGES)))
    a.compute_join_trees()
    assert a.trees.count() >= 1


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        algorithms("SVM")
    assert [a.name for a in algorithms()] == ["RF", "GBM", "XT", "XGB", "KNN", "LR"]


@pytest.mark.parametrize("algorithm", ["LR", "RF", "KNN"])
def test_models_beat_the_majority_on_a_planted_signal(spark, catalog, grown, algorithm):
    a = augmenter(spark, catalog, LINKS[:1])
    a.compute_join_trees()
    got = a.evaluate_augmented_table(1, algorithm).first()
    assert got["accuracy"] > 0.8 and got["model"] == algorithm
    worth = {r["feature"]: r["importance"] for r in a.importances.collect()}
    assert max(worth, key=worth.get) == "good__signal"
    assert "good__gk" not in worth
    assert a.get_best_result().first()["tree_id"] == 1
    assert a.explain_result(1, algorithm).count() == len(worth)
    assert a.get_feature_importance("good", "signal").count() == 1


def test_the_evaluation_query_takes_all_grown_trees(spark):
    from checks import queries
    sf = "/root/testdata/sf0.001"
    got = {(r["tree_id"], r["rank"]) for r in queries.f7_evaluate_trees(spark, sf).collect()}
    want = {(r["tree_id"], r["rank"]) for r in queries.c2_join_trees(spark, sf).select("tree_id", "rank").collect()}
    assert got == want and len(got) > 1
