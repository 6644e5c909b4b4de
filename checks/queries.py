"""One query per operator, each over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from joingrove import Augmenter, schemas
from joingrove.functions import stats
from joingrove.functions.naming import qualify, quote, short_table_label
from joingrove.functions.prepare import binned, prepare, profile
from joingrove.operators import curate, edges as E, evaluate, joins as J, matchers as M, quality, selection as S
from joingrove.operators.models import algorithms
from joingrove.plans import jointree as JT
from joingrove.sources import edge_files
from joingrove.sources.catalog import Catalog, read_links
from joingrove.sources.staging import fresh_path, stage
from joingrove.streaming import hop as H

STAR = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]
ALL = STAR + ["benchmark", "conversations", "documents", "embeddings", "events", "labels", "pages"]
TARGET = "is_f"

# Links of the chain the tree queries grow along.
CHAIN = [("orders", "customer", "o_custkey", "c_custkey"),
         ("customer", "nation", "c_nationkey", "n_nationkey"),
         ("nation", "region", "n_regionkey", "r_regionkey")]

# Known links of the star tables: foreign keys and what they refer to.
KEYS = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey")]

# (left table, left key, right table, right key) whose ratios are checked.
LINKS = [("orders", "o_custkey", "customer", "c_custkey"),
         ("customer", "c_nationkey", "nation", "n_nationkey"),
         ("nation", "n_regionkey", "region", "r_regionkey"),
         ("orders", "o_orderkey", "lineitem", "l_orderkey"),
         ("lineitem", "l_orderkey", "orders", "o_orderkey"),
         ("lineitem", "l_partkey", "part", "p_partkey"),
         ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
         ("customer", "c_custkey", "events", "user_id"),
         ("documents", "doc_id", "labels", "doc_id"),
         ("documents", "doc_id", "embeddings", "vec_id"),
         ("documents", "doc_id", "benchmark", "item_id")]


def star(spark: SparkSession, sf: str) -> Catalog:
    return Catalog.from_parquet_dir(spark, sf, STAR)


def everything(spark: SparkSession, sf: str) -> Catalog:
    return Catalog.from_parquet_dir(spark, sf, ALL)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    # Adding 0 turns a negative zero into zero.
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def orders_base(catalog: Catalog) -> DataFrame:
    """orders with a two-valued target and its own key as row id."""
    df = catalog.qualified("orders")
    return (df.withColumn(TARGET, (F.col("orders__o_orderstatus") == "F").cast("int"))
            .withColumn(J.ROW_ID, F.col("orders__o_orderkey")).drop("orders__o_orderstatus"))


# -- sources ------------------------------------------------------------------


def a1_csv_scan(spark, sf):
    path = fresh_path(spark, "orders-csv")
    (spark.read.parquet(f"{sf}/orders.parquet").write.option("header", True).option("quote", '"')
     .option("escape", "\\").csv(path))
    catalog = Catalog(spark).add("orders", path, "csv")
    return catalog.table("orders").select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus",
        "o_totalprice", F.substring("o_orderdate", 1, 10).alias("o_orderday"), "o_orderpriority")


def a2_plain_scan(spark, sf):
    return everything(spark, sf).table("labels").select(
        "doc_id", F.col("quality").cast("long"), F.col("toxic").cast("long"))


def a3_qualified(spark, sf):
    return star(spark, sf).qualified("customer", "c_mktsegment")


def a4_base_table(spark, sf):
    a = Augmenter(spark, catalog=star(spark, sf))
    a.set_base_table("customer", "c_mktsegment", row_key="c_custkey")
    return a.base_frame.select(J.ROW_ID, a.target, *a.base_features)


def a4_base_table_first(spark, sf):
    """The base table is set before any repository is chosen and stays when one is."""
    root, dataset = sf.rstrip("/").rsplit("/", 1)
    a = Augmenter(spark, root=root)
    a.set_base_table(f"{dataset}/customer.parquet", "c_mktsegment", row_key="c_custkey")
    a.set_dataset_repository([dataset])
    assert f"{dataset}/customer.parquet" in a.get_tables_repository()
    return a.base_frame.select(J.ROW_ID, a.target, *[
        F.col(f"`{c}`").alias(f"customer__{c.split('__')[-1]}") for c in a.base_features])


def a5_repository(spark, sf):
    """The folder seen as one dataset of a repository, with a table of another one added before."""
    root, dataset = sf.rstrip("/").rsplit("/", 1)
    a = Augmenter(spark, root=root)
    a.add_table("more/region", f"{sf}/region.parquet", "parquet")
    a.set_dataset_repository([dataset])
    return a.tables().select(F.element_at(F.split("name", "/"), -1).alias("name"), "n_rows",
                             F.col("n_cols").cast("long").alias("n_cols"))


def a6_tables(spark, sf):
    return everything(spark, sf).tables().select(
        "name", "n_rows", F.col("n_cols").cast("long").alias("n_cols"))


def a7_add_table_coma(spark, sf):
    """All tables but one are matched, then that one alone against them."""
    a = Augmenter(spark, catalog=Catalog.from_parquet_dir(spark, sf, [t for t in ALL if t != "orders"]))
    a.find_relationships("coma", 0.5, use_cache=False, instances=True)
    a.add_table("orders", f"{sf}/orders.parquet", "parquet")
    return rounded(a.edges, "weight")


def a7_add_table(spark, sf):
    a = Augmenter(spark, catalog=Catalog.from_parquet_dir(spark, sf, [t for t in ALL if t != "supplier"]))
    a.find_relationships("jaccard", 0.5, use_cache=False)
    a.add_table("supplier", f"{sf}/supplier.parquet", "parquet")
    return rounded(a.edges, "weight")


def edges(spark, sf):
    """Edges between the tables whose columns share more than half of their values."""
    kept = E.above(M.jaccard(everything(spark, sf)), 0.5).selectExpr(
        "table1 AS from_table", "table2 AS to_table", "col1 AS from_col", "col2 AS to_col", "weight")
    return E.both_directions(kept)


def a8_remove_table(spark, sf):
    return rounded(E.without_table(edges(spark, sf), "part"), "weight")


def a9_edge_text(spark, sf):
    """Edges written as text with two records that are none; those are reported."""
    path = fresh_path(spark, "edge-text")
    text = edge_files.edge_text(edges(spark, sf))
    odd = spark.read.parquet(f"{sf}/region.parquet").limit(2).selectExpr("concat('a--b--', r_name) AS value")
    text.unionByName(odd).write.option("lineSep", edge_files.RECORD_SEPARATOR).text(path)
    a = Augmenter(spark, catalog=everything(spark, sf))
    found = a.read_relationships(path)
    return rounded(found, "weight").withColumn("n_malformed", F.lit(a.malformed_relationships.count()))


SAVED = ["customer", "nation", "orders", "region"]


def a10_saved_edges(spark, sf):
    """Edges saved for half of the customers are not served for all of them."""
    root, half = fresh_path(spark, "saved"), fresh_path(spark, "half")
    spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey % 2 = 0").write.parquet(half)
    whole = Catalog.from_parquet_dir(spark, sf, SAVED)
    for catalog in (whole.add("customer", half), whole):
        a = Augmenter(spark, catalog=catalog, cache_root=root)
        a.find_relationships("coma", 0.3, use_cache=True, instances=True)
    return rounded(a.edges, "weight")


def a11_partial_join(spark, sf):
    catalog = star(spark, sf)
    right = J.one_row_per_key(catalog.qualified("customer"), "customer__c_custkey")
    joined_ = J.left_join_one(orders_base(catalog), "orders__o_custkey", right, "customer__c_custkey")
    return stage(joined_, "partial").select(
        J.ROW_ID, TARGET, "orders__o_totalprice", "customer__c_acctbal", "customer__c_mktsegment")


def a12_links(spark, sf):
    """Full-overlap edges written as the link file of a dataset and read as known links."""
    path = fresh_path(spark, "links")
    known = edges(spark, sf).filter("weight = 1")
    known.selectExpr("from_table AS fk_table", "from_col AS fk_column", "to_table AS pk_table",
                     "to_col AS pk_column").write.option("header", True).csv(path)
    return read_links(spark, path, "star")


# -- relationships --------------------------------------------------------------


def b1_table_pairs(spark, sf):
    catalog = everything(spark, sf)
    sizes = catalog.tables().select("name", "n_rows")
    return (M.table_pairs(catalog.columns())
            .join(sizes.selectExpr("name AS table1", "n_rows AS rows1"), "table1")
            .join(sizes.selectExpr("name AS table2", "n_rows AS rows2"), "table2")
            .select("table1", "table2", "rows1", "rows2"))


def b2_composite(spark, sf):
    pairs = M.composite(everything(spark, sf), instances=True)
    return rounded(pairs, "name_score", "type_score", "inst_score", "weight")


def b3_jaccard(spark, sf):
    return rounded(M.jaccard(everything(spark, sf)), "weight")


def b3_near_jaccard(spark, sf):
    return rounded(M.near_jaccard(everything(spark, sf)), "weight")


def b6_matcher_quality(spark, sf):
    """Precision and recall of all thresholds of both matchers against the foreign keys of the star tables."""
    known = spark.createDataFrame([(a, b, c, d) for a, c, b, d in KEYS], "from_table string, to_table string, from_col string, to_col string")
    catalog = star(spark, sf)
    both = [quality.match_quality(scored, known).withColumn("matcher", F.lit(name))
            for name, scored in (("coma", M.composite(catalog)), ("jaccard", M.jaccard(catalog)))]
    return rounded(reduce(DataFrame.unionByName, both), "threshold", "precision", "recall")


def b4_threshold(spark, sf):
    return rounded(E.above(M.jaccard(everything(spark, sf)), 0.5), "weight")


def b5_both_directions(spark, sf):
    return rounded(edges(spark, sf), "weight")


def b6_discovery(spark, sf):
    return rounded(M.find_relationships(everything(spark, sf), 0.5, "coma", instances=True), "weight")


def b6_discovery_names(spark, sf):
    """The default matcher: names and types."""
    return rounded(M.find_relationships(everything(spark, sf)), "weight")


def b6_discovery_jaccard(spark, sf):
    return rounded(M.find_relationships(everything(spark, sf), 0.5, "jaccard", fuzzy=False), "weight")


def b7_edges_from(spark, sf):
    return rounded(E.edges_from(edges(spark, sf), "orders"), "weight")


def b8_edges_between(spark, sf):
    return rounded(E.edges_between(edges(spark, sf), "lineitem", "orders"), "weight")


def b9_best_edges(spark, sf):
    return rounded(E.best_edges(edges(spark, sf)), "weight")


def b10_weight_matrix(spark, sf):
    return rounded(E.weight_matrix(edges(spark, sf), ALL), *ALL)


def b11_column_matrix(spark, sf):
    cols = ["o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"]
    return rounded(E.column_matrix(edges(spark, sf), "lineitem", "orders", cols), *cols)


def b12_edges_of_pair(spark, sf):
    return rounded(E.edges_of_pair(edges(spark, sf), "orders", "lineitem"), "weight")


def b13_add_edge(spark, sf):
    return rounded(E.add_edge(edges(spark, sf), "orders", "o_orderpriority", "region", "r_name", 0.25), "weight")


def b14_remove_edge(spark, sf):
    return rounded(E.remove_edge(edges(spark, sf), "customer", "c_custkey", "orders", "o_custkey"), "weight")


def b15_update_edge(spark, sf):
    return rounded(E.update_edge(edges(spark, sf), "orders", "o_custkey", "customer", "c_custkey", 0.75), "weight")


def b16_cascade(spark, sf):
    """Trees follow an edited edge when they are next read."""
    a = _chain_session(spark, sf, CHAIN[:1])
    a.compute_join_trees()
    a.add_relationship("customer", "c_nationkey", "nation", "n_nationkey", 0.9)
    return a.tree_joins.select("tree_id", "join_idx", "from_table", "to_table", "non_null_ratio")


def b17_short_labels(spark, sf):
    name = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("_"), F.col("doc_id"), F.lit(".csv"))
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", short_table_label(name).alias("label"))


# -- trees ------------------------------------------------------------------------


def _links_frame(spark, links) -> DataFrame:
    return E.both_directions(spark.createDataFrame(
        [(a, b, c, d, 1.0) for a, b, c, d in links], schemas.EDGES))


def _chain_session(spark, sf, links=CHAIN) -> Augmenter:
    a = Augmenter(spark, catalog=star(spark, sf))
    a.set_base_frame("orders", orders_base(a.catalog), TARGET)
    a.set_relationships(_links_frame(spark, links))
    return a


def grown(spark, sf) -> Augmenter:
    """The chain grown from the tables."""
    a = _chain_session(spark, sf)
    a.compute_join_trees()
    return a


def _tree_rows(a: Augmenter) -> DataFrame:
    return rounded(a.trees.select("tree_id", "begin", "rank", F.array_join(
        F.array_sort("features"), ",").alias("features"), F.array_join("join_keys", ",").alias("join_keys")), "rank")


def c1_start(spark, sf):
    base = orders_base(star(spark, sf))
    features = [c for c in base.columns if c not in (TARGET, J.ROW_ID)]
    partial = H.start(base, TARGET, features, ["orders__o_custkey"])
    return partial.frame.agg(
        F.lit(0).alias("tree_id"), F.lit("orders").alias("begin"), F.lit(0.0).alias("rank"),
        F.lit(",".join(sorted(features))).alias("features"), F.count(F.lit(1)).alias("n_rows"),
        F.sum(H.TARGET).alias("n_positive"))


def c2_join_trees(spark, sf):
    """The whole chain grown anew: every tree with its rank, features and keys."""
    return _tree_rows(grown(spark, sf))


def c2_target_edge(spark, sf):
    """Edges that touch the target are no joins."""
    a = _chain_session(spark, sf, CHAIN + [("orders", "nation", TARGET, "n_regionkey")])
    a.compute_join_trees()
    return _tree_rows(a)


def _links_of(spark, sf) -> JT.Links:
    return JT.Links(JT.read_edges(edges(spark, sf)))


def c2_reachable(spark, sf):
    return spark.createDataFrame(sorted(_links_of(spark, sf).levels("region").items()), "table string, depth int")


def _edge_rows(spark, found) -> DataFrame:
    return rounded(spark.createDataFrame(
        [(e.from_table, e.to_table, e.from_col, e.to_col, e.weight) for e in found], schemas.EDGES), "weight")


def c3_neighbours(spark, sf):
    links = _links_of(spark, sf)
    frontier = {e.to_table for e in links.leaving("region")}
    return _edge_rows(spark, [e for t in sorted(frontier) for e in links.leaving(t)])


def c4_unvisited(spark, sf):
    links = _links_of(spark, sf)
    visited = {e.to_table for e in links.leaving("region")}
    return spark.createDataFrame([(t,) for t in sorted({x for t in ALL for x in links.unvisited(t, visited)})], "table string")


def c5_best_keys(spark, sf):
    links = _links_of(spark, sf)
    return _edge_rows(spark, [e for a in ALL for b in links.unvisited(a, set()) for e in links.best_keys(a, b)])


def c6_type_check(spark, sf):
    """Similar column pairs whose types may be joined."""
    catalog = everything(spark, sf)
    pairs = M.composite(catalog, instances=True).filter("weight > 0.4").select("table1", "col1", "table2", "col2")
    return spark.createDataFrame([tuple(r) for r in pairs.collect() if J.joinable(
        catalog.table(r["table1"]), r["col1"], catalog.table(r["table2"]), r["col2"])], pairs.schema)


def c7_one_per_key(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    return J.one_row_per_key(df, "l_orderkey").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def c8_left_join(spark, sf):
    catalog = star(spark, sf)
    left, right = orders_base(catalog), catalog.qualified("lineitem")
    one = J.one_row_per_key(right, "lineitem__l_orderkey")
    return J.left_join_one(left, "orders__o_orderkey", one, "lineitem__l_orderkey").select(
        J.ROW_ID, TARGET, "orders__o_totalprice", "lineitem__l_orderkey", "lineitem__l_partkey",
        "lineitem__l_quantity", "lineitem__l_returnflag")


def c8_left_join_hot(spark, sf):
    """Few users hold all events: their rows are spread."""
    catalog = everything(spark, sf)
    left, right = catalog.qualified("events"), catalog.qualified("customer")
    counts = J.key_counts(left, "events__user_id")
    summary = J.key_summary(counts, left.count(), right, "customer__c_custkey")
    one = J.one_row_per_key(right, "customer__c_custkey")
    return J.left_join_one(left, "events__user_id", one, "customer__c_custkey", list(summary.hot)).select(
        "events__event_id", "events__user_id", "customer__c_custkey", "customer__c_acctbal")


def _summaries(spark, sf) -> list[tuple]:
    catalog = everything(spark, sf)
    return [(t1, c1, t2, c2, J.key_summary(J.key_counts(catalog.table(t1), c1), catalog.table(t1).count(),
                                           catalog.table(t2), c2)) for t1, c1, t2, c2 in LINKS]


def _ratio_rows(spark, found) -> DataFrame:
    return rounded(spark.createDataFrame(
        [(t1, c1, t2, c2, s.ratio) for t1, c1, t2, c2, s in found],
        "from_table string, from_col string, to_table string, to_col string, ratio double"), "ratio")


def c9_ratio(spark, sf):
    return _ratio_rows(spark, _summaries(spark, sf))


def c10_prune(spark, sf):
    return _ratio_rows(spark, [r for r in _summaries(spark, sf) if r[4].passes(0.5)])


def c11_new_features(spark, sf):
    """Columns of a joined table that survive preparation, texts of any length among them."""
    catalog, rows = everything(spark, sf), []
    for name in ALL:
        df = catalog.qualified(name)
        numeric, categories = profile(df, df.columns)
        rows += [(f,) for f in [*numeric, *categories]]
    return spark.createDataFrame(rows, "feature string")


def _hop(spark, sf, table="customer", left="o_custkey", right="c_custkey", top_k=10) -> H.HopResult:
    catalog = star(spark, sf)
    base = orders_base(catalog)
    features = [c for c in base.columns if c not in (TARGET, J.ROW_ID)]
    options = H.Options(top_k=top_k)
    first = H.start(base, TARGET, features, [qualify("orders", left)], options)
    return H.hop(first, catalog.qualified(table), table, qualify("orders", left), qualify(table, right),
                 [], options, last=True)


def _hop_scores(spark, sf, **hop) -> tuple[H.HopResult, DataFrame]:
    result = _hop(spark, sf, **hop)
    return result, spark.createDataFrame(JT.score_rows(result, 1, 0), schemas.FEATURE_SCORES)


def _shared_scores(spark, sf) -> tuple[H.HopResult, DataFrame]:
    """Scores of the hop to customer."""
    return _hop_scores(spark, sf)


def c12_hop(spark, sf):
    result, scores = _hop_scores(spark, sf)
    return rounded(scores, "score").withColumn("tree_score", F.round(F.lit(result.score), 6))


def c12_hop_lineitem(spark, sf):
    result, scores = _hop_scores(spark, sf, table="lineitem", left="o_orderkey", right="l_orderkey")
    return rounded(scores, "score").withColumn("tree_score", F.round(F.lit(result.score), 6))


def c12_hop_text(spark, sf):
    """labels joined to documents: whole texts are features with as many values as there are texts."""
    catalog = everything(spark, sf)
    base = (catalog.qualified("labels").withColumn(TARGET, F.col("labels__toxic")).drop("labels__toxic")
            .withColumn(J.ROW_ID, F.col("labels__doc_id")))
    features = ["labels__doc_id", "labels__quality"]
    first = H.start(base, TARGET, features, ["labels__doc_id"])
    result = H.hop(first, catalog.qualified("documents"), "documents", "labels__doc_id", "documents__doc_id", [],
                   H.Options(), last=True)
    scores = spark.createDataFrame(JT.score_rows(result, 1, 0), schemas.FEATURE_SCORES)
    return rounded(scores, "score").withColumn("tree_score", F.round(F.lit(result.score).cast("double"), 6))


def c13_tree_score(spark, sf):
    result = _hop(spark, sf)
    return rounded(spark.createDataFrame([(1, 0, H.mean_score(result.rel, result.red))],
                                         "tree_id int, join_idx int, score double"), "score")


def c14_kept_scores(spark, sf):
    return rounded(_shared_scores(spark, sf)[1].filter("selected"), "score")


def c15_tree_joins(spark, sf):
    return rounded(grown(spark, sf).tree_joins, "non_null_ratio")


def c16_bridge(spark, sf):
    """With one candidate a join keeps no feature: it is walked, and the
    features stay those of the tree before it."""
    result = _hop(spark, sf, top_k=1)
    return rounded(spark.createDataFrame(
        [(result.outcome, len(result.partial.selected), f, kind, v)
         for kind, scores in (("rel", result.rel_discarded), ("red", result.red_discarded))
         for f, v in scores], "outcome string, n_features long, feature string, kind string, score double"), "score")


def c17_top_trees(spark, sf):
    return rounded(JT.top_trees(grown(spark, sf).trees, 2).select("tree_id", "rank"), "rank")


def c18_tree_by_id(spark, sf):
    return rounded(grown(spark, sf).get_tree_by_id(1).select("tree_id", "begin", "rank"), "rank")


def _given_tree(spark, joins, features) -> tuple[DataFrame, DataFrame]:
    """A tree with chosen joins and features, as an edit would leave it."""
    edges_ = [JT.Edge(a, b, c, d, 1.0) for a, b, c, d in joins]
    keys = [k for e in edges_ for k in (e.left_key, e.right_key)]
    trees = spark.createDataFrame([(1, "orders", 1.0, features, keys)], schemas.TREES)
    return trees, spark.createDataFrame(
        [(1, i, *j, 1.0, False) for i, j in enumerate(joins)], schemas.TREE_JOINS)


GIVEN = ["orders__o_totalprice", "orders__o_custkey", "customer__c_acctbal", "customer__c_mktsegment",
         "customer__c_nationkey", "nation__n_name", "region__r_name"]


def c19_materialise(spark, sf):
    catalog = star(spark, sf)
    trees, joins = _given_tree(spark, CHAIN, GIVEN)
    return JT.materialise(catalog, orders_base(catalog), TARGET, trees, joins, 1,
                          include_target=True, keep=[J.ROW_ID])


def c19_fan_out(spark, sf):
    catalog = star(spark, sf)
    trees, joins = _given_tree(spark, [("orders", "lineitem", "o_orderkey", "l_orderkey")],
                               ["orders__o_totalprice", "lineitem__l_linenumber", "lineitem__l_extendedprice"])
    return JT.materialise(catalog, orders_base(catalog), TARGET, trees, joins, 1, dedupe=False,
                          keep=[J.ROW_ID])


def c19_fan_out_hot(spark, sf):
    """A key and null that hold a third of both sides each, dealt over a grid of tasks."""
    key = "CASE WHEN {0} % 3 = 0 THEN 1 WHEN {0} % 3 = 1 THEN NULL ELSE {0} END"
    catalog = star(spark, sf)
    left = catalog.table("customer").selectExpr("c_custkey", key.format("c_custkey") + " AS lk")
    right = catalog.table("supplier").selectExpr("s_suppkey", key.format("s_suppkey") + " AS rk")
    return J.left_join_all(left, "lk", right, "rk", 2000).select("c_custkey", "s_suppkey")


def c20_remove_table(spark, sf):
    """The table in the middle goes, and with it what hangs below."""
    a = grown(spark, sf)
    trees, joins, _ = JT.remove_table(a.trees, a.tree_joins, a.feature_scores, 2, "nation")
    return trees.filter("tree_id = 2").select(
        "tree_id", F.array_join(F.array_sort("features"), ",").alias("features"),
        F.size("join_keys").cast("long").alias("n_keys")).join(
        joins.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_joins")), "tree_id", "left").fillna(0)


def c21_tree_nodes(spark, sf):
    a = grown(spark, sf)
    return rounded(JT.tree_nodes(a.trees, a.tree_joins), "rank")


def c22_tree_summary(spark, sf):
    return rounded(grown(spark, sf).explain_tree(2), "rank", "non_null_ratio")


# -- features ---------------------------------------------------------------------


def joined(spark, sf) -> DataFrame:
    """orders with customer and nation, raw."""
    catalog = star(spark, sf)
    frame = JT.replay(catalog, orders_base(catalog), [JT.Edge(*j, 1.0) for j in CHAIN[:2]], balance=False)
    return frame


NUMBERS = ["orders__o_custkey", "orders__o_totalprice", "customer__c_acctbal", "customer__c_nationkey",
           "nation__n_regionkey"]
CODES = ["customer__c_nationkey", "nation__n_regionkey", "orders__o_custkey"]


def d1_prepare(spark, sf):
    catalog = star(spark, sf)
    base = orders_base(catalog).withColumn("orders__constant", F.lit(7))
    features = [c for c in base.columns if c not in (TARGET, J.ROW_ID)]
    return rounded(prepare(base, features, [J.ROW_ID])[0], "orders__o_totalprice", "orders__o_orderdate")


def d2_average_rank(spark, sf):
    return stats.rank_columns(joined(spark, sf), NUMBERS)


def d2_average_rank_ranges(spark, sf):
    """The same ranks, with the values of a feature cut into ranges."""
    return stats.rank_columns(joined(spark, sf), NUMBERS, chunk_rows=1000)


def d3_pearson(spark, sf):
    df = joined(spark, sf).withColumn("constant", F.lit(1.0))
    return rounded(stats.pearson(df, NUMBERS + ["constant"], TARGET), "score")


def d4_spearman(spark, sf):
    df = joined(spark, sf).withColumn("constant", F.lit(1.0))
    return rounded(stats.spearman(df, NUMBERS[:1] + NUMBERS[2:] + ["constant"], "orders__o_totalprice"), "score")


def d4_spearman_binary(spark, sf):
    df = joined(spark, sf).withColumn("constant", F.lit(1.0))
    return rounded(stats.spearman_binary(df, NUMBERS + ["constant"], TARGET), "score")


def d5_relevance(spark, sf):
    df = (joined(spark, sf).withColumn("constant", F.lit(1.0)).withColumn("leak", F.col(TARGET) * 2)
          .withColumn("nothing", F.lit(None).cast("double")))
    return rounded(S.measure_relevance(df, NUMBERS + ["constant", "leak", "nothing", TARGET], TARGET), "score")


def d5_relevance_pearson(spark, sf):
    df = joined(spark, sf).withColumn("constant", F.lit(1.0)).withColumn("leak", F.col(TARGET) * 2)
    return rounded(S.measure_relevance(df, NUMBERS + ["constant", "leak"], TARGET, method="pearson"), "score")


def d6_top_k(spark, sf):
    counts = stats.value_counts(joined(spark, sf), NUMBERS, TARGET)
    found = H.best_features([tuple(r) for r in stats.spearman_of_counts(counts).collect()], 3)
    return rounded(spark.createDataFrame([(f, v, True) for f, v, _ in found.top],
                                         "feature string, score double, selected boolean"), "score")


def d7_relevance_plain(spark, sf):
    """Only the features the frame has are scored, in no order."""
    scores = S.measure_relevance(joined(spark, sf), NUMBERS + ["absent"], TARGET, ordered=False)
    return rounded(scores.filter("selected").select("feature", "score"), "score")


def d8_bins(spark, sf):
    return binned(joined(spark, sf), NUMBERS, [J.ROW_ID])


def _information(df: DataFrame, terms) -> DataFrame:
    plan = stats.EntropyPlan()
    rows = [(name, make(plan)) for name, make in terms]
    return rounded(plan.evaluate(df, rows).select(F.col("feature").alias("measure"), "score"), "score")


def d9_entropy(spark, sf):
    return _information(joined(spark, sf), [
        (c, lambda p, c=c: p.h(c)) for c in CODES + [TARGET, "customer__c_mktsegment"]])


def d10_contingency(spark, sf):
    return stats.contingency(joined(spark, sf), "nation__n_regionkey", TARGET).select(
        F.col("x").cast("long"), F.col("y").cast("long"), "n")


def d11_conditional_entropy(spark, sf):
    return _information(joined(spark, sf), [
        (c, lambda p, c=c: p.conditional_entropy(c, TARGET)) for c in CODES])


def d12_mutual_information(spark, sf):
    return _information(joined(spark, sf), [(c, lambda p, c=c: p.mutual(c, TARGET)) for c in CODES])


def d13_conditional_information(spark, sf):
    return _information(joined(spark, sf), [
        ("a", lambda p: p.conditional_mutual("orders__o_custkey", TARGET, "nation__n_regionkey")),
        ("b", lambda p: p.conditional_mutual("customer__c_nationkey", TARGET, "orders__o_orderpriority"))])


NEW = ["customer__c_acctbal", "customer__c_nationkey", "nation__n_regionkey"]
CHOSEN = ["orders__o_custkey", "orders__o_totalprice"]


def d14_mrmr(spark, sf):
    return rounded(S.mrmr(joined(spark, sf), NEW, CHOSEN, TARGET), "score")


def d15_jmi(spark, sf):
    return rounded(S.mrmr(joined(spark, sf), NEW, CHOSEN, TARGET, jmi=True), "score")


def d16_normalise(spark, sf):
    return rounded(S.measure_redundancy(joined(spark, sf), CHOSEN, NEW, TARGET), "score")


def d17_both(spark, sf):
    rel, red = S.measure_relevance_and_redundancy(joined(spark, sf), CHOSEN, NEW, TARGET)
    rel = rel.filter("selected").select(F.lit("rel").alias("kind"), "feature", "score", "selected")
    return rounded(rel.unionByName(red.select(F.lit("red").alias("kind"), "feature", "score", "selected")), "score")


def d18_cmim(spark, sf):
    return rounded(S.measure_conditional_redundancy(
        joined(spark, sf), ["orders__o_orderpriority", "nation__n_regionkey"], NEW[:2], TARGET), "score")


def d19_group_redundancy(spark, sf):
    return rounded(S.measure_group_redundancy(joined(spark, sf), CODES, TARGET), "score")


def d20_joint_information(spark, sf):
    return rounded(S.measure_joint_mutual_information(joined(spark, sf), CODES[2:], NEW, TARGET), "score")


# -- edits ----------------------------------------------------------------------------


def _one_join(spark, ratio) -> DataFrame:
    return spark.createDataFrame(
        [(1, 0, "orders", "customer", "o_custkey", "c_custkey", ratio, False)], schemas.TREE_JOINS)


def _show(spark, sf, selected, change=None) -> DataFrame:
    result, scores = _shared_scores(spark, sf)
    scores = change(scores) if change else scores
    return rounded(curate.show_features(scores, _one_join(spark, result.ratio), 1, selected),
                   "non_null_ratio", "rel", "red")


def e1_selected(spark, sf):
    return _show(spark, sf, True)


def e2_discarded(spark, sf):
    return _show(spark, sf, False)


def e3_adjust_relevance(spark, sf):
    return _show(spark, sf, True, lambda s: curate.adjust_relevance(s, 1, "customer__c_acctbal", 0.9))


def e4_adjust_redundancy(spark, sf):
    return _show(spark, sf, True, lambda s: curate.adjust_redundancy(s, 1, "customer__c_acctbal", 0.1))


def e5_adjust_ratio(spark, sf):
    result, scores = _shared_scores(spark, sf)
    joins = curate.adjust_non_null_ratio(_one_join(spark, result.ratio), 1, "customer", 0.25)
    return rounded(curate.show_features(scores, joins, 1), "non_null_ratio", "rel", "red")


def _moved(spark, sf, move, features) -> DataFrame:
    result, scores = _shared_scores(spark, sf)
    kept = [f for f, _ in result.red]
    trees = spark.createDataFrame([(1, "orders", float(result.score), kept, [])], schemas.TREES)
    trees, scores = move(trees, scores, 1, features)
    listed = trees.select("tree_id", F.array_join(F.array_sort("features"), ",").alias("tree_features"))
    return rounded(scores.join(listed, "tree_id"), "score")


def e6_discard(spark, sf):
    return _moved(spark, sf, curate.move_to_discarded, ["customer__c_acctbal", "customer__c_mktsegment"])


def e7_select(spark, sf):
    return _moved(spark, sf, curate.move_to_selected, ["customer__c_custkey"])


# -- evaluation ------------------------------------------------------------------------


def f1_evaluation_table(spark, sf):
    catalog = star(spark, sf)
    trees, joins = _given_tree(spark, CHAIN, GIVEN)
    return evaluate.evaluation_table(catalog, orders_base(catalog), TARGET, trees, joins, 1)


def f2_split(spark, sf):
    return evaluate.split(orders_base(star(spark, sf))).select(J.ROW_ID, "is_test")


# Columns whose most frequent class per value serves as a fixed prediction.
RULES = {1: ["orders__o_orderpriority", "customer__c_mktsegment"], 2: ["customer__c_nationkey", "nation__n_regionkey"],
         3: ["orders__o_custkey"]}


def _rule_predictions(spark, sf) -> DataFrame:
    """(rule, row): the majority class of the row's value, per column."""
    df = joined(spark, sf)
    long = df.selectExpr(TARGET, *[f"cast({quote(c)} AS string) AS {quote(c)}" for r in RULES.values() for c in r])
    long = long.unpivot([TARGET], [quote(c) for r in RULES.values() for c in r], "feature", "value")
    counts = long.groupBy("feature", "value").agg(
        F.sum(TARGET).alias("ones"), F.count(F.lit(1)).alias("n"))
    return long.join(counts.selectExpr("feature", "value", "CASE WHEN ones * 2 > n THEN 1 ELSE 0 END AS prediction"),
                     ["feature", "value"]).withColumnRenamed(TARGET, "label")


def _rule_results(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Results and importances of the rules: accuracy, and what it adds to always saying 0."""
    right = (F.col("prediction") == F.col("label")).cast("double")
    per = _rule_predictions(spark, sf).groupBy("feature").agg(
        F.avg(right).alias("accuracy"), F.avg((F.col("label") == 0).cast("double")).alias("plain"))
    owner = F.create_map(*[x for t, cs in RULES.items() for c in cs for x in (F.lit(c), F.lit(t))])
    per = per.withColumn("tree_id", owner[F.col("feature")])
    results = per.groupBy("tree_id").agg(F.max("accuracy").alias("accuracy")).select(
        "tree_id", F.lit("RULE").alias("model"), F.lit("majority rule").alias("model_full_name"),
        F.col("tree_id").cast("double").alias("rank"), "accuracy")
    importances = per.select("tree_id", F.lit("RULE").alias("model"), "feature",
                             (F.col("accuracy") - F.col("plain")).alias("importance"))
    return results, importances


def _reaches(results: DataFrame, share: float) -> DataFrame:
    """Whether a model is about as good as always saying the more frequent class."""
    return results.withColumn("reaches", F.col("accuracy") >= share - 0.05).drop("accuracy")


def _majority(base: DataFrame) -> float:
    """Share of the more frequent class among the test rows."""
    mean = evaluate.split(base).filter("is_test").agg(F.avg(TARGET)).first()[0] or 0.0
    return max(mean, 1 - mean)


def f3_algorithms(spark, sf):
    """Every algorithm on a rule that crosses two columns: neither the more frequent class nor a straight line tells it."""
    base = star(spark, sf).table("customer").selectExpr(
        f"c_custkey AS {J.ROW_ID}", "c_acctbal", "c_nationkey", f"cast((c_acctbal > 4500) = (c_nationkey < 12) AS int) AS {TARGET}")
    rows, _ = evaluate.model_rows(base, TARGET)
    rows = stage(rows, "model-rows")
    train, test = rows.filter("NOT is_test"), rows.filter("is_test")
    hit = (F.col("prediction") == F.col("label")).cast("double")
    scores = [a.fit(train.select("label", "v"))(test.select("label", "v")).agg(
        F.lit(a.name).alias("model"), F.count(F.lit(1)).alias("n_test"), F.avg(hit).alias("accuracy")) for a in algorithms()]
    return _reaches(reduce(DataFrame.unionByName, scores), min(_majority(base) + 0.2, 0.85))


def _hinted(spark, sf) -> DataFrame:
    """Orders with a column that tells the target: a model that works is right on every row, and needs nothing else."""
    return orders_base(star(spark, sf)).withColumn("orders__hint", F.col(TARGET) * 2.0)


def f4_train(spark, sf):
    """One model fitted on an augmented table, and whether it is right about the test rows."""
    catalog = star(spark, sf)
    trees, joins = _given_tree(spark, CHAIN[:1], ["orders__o_totalprice", "orders__hint", "customer__c_acctbal"])
    table = evaluate.evaluation_table(catalog, _hinted(spark, sf), TARGET, trees, joins, 1)
    rows, _ = evaluate.model_rows(table, TARGET)
    predict = algorithms("LR")[0].fit(rows.filter("NOT is_test").select("label", "v"))
    return predict(rows.filter("is_test")).select(
        J.ROW_ID, F.col("label").cast("int").alias("label"), (F.col("prediction") == F.col("label")).alias("predicted"))


def f5_accuracy(spark, sf):
    return rounded(evaluate.accuracy(_rule_predictions(spark, sf)), "accuracy")


def f6_importance(spark, sf):
    """The column that tells the target is worth much, one that the model has no use for exactly nothing."""
    trees, joins = _given_tree(spark, CHAIN[:1], ["orders__o_totalprice", "orders__hint", "customer__c_acctbal"])
    found = evaluate.evaluate_tree(star(spark, sf), _hinted(spark, sf), TARGET, trees, joins, 1, "GBM")[1]
    return found.select("tree_id", "model", "feature", (F.col("importance") > 0.2).alias("useful"), (F.col("importance") == 0).alias("idle"))


def f7_evaluate_trees(spark, sf):
    """All trees grown from the tables; of their features only those of the best one have the column that tells the target."""
    a = grown(spark, sf)
    best = JT.top_trees(a.trees, 1).first()["tree_id"]
    told = F.array_append("features", F.lit("orders__hint"))
    trees = a.trees.withColumn("features", F.when(F.col("tree_id") == best, told).otherwise(F.col("features")))
    found = evaluate.evaluate_trees(a.catalog, _hinted(spark, sf), TARGET, trees, a.tree_joins, a.trees.count(), "LR")[0]
    found = found.select("tree_id", "model", "rank", "accuracy", (F.col("accuracy") == 1).alias("exact"))
    return _reaches(rounded(found, "rank"), _majority(orders_base(star(spark, sf)))).select("tree_id", "model", "rank", "reaches", "exact")


def f8_evaluate_tree(spark, sf):
    catalog = star(spark, sf)
    # A column that tells the target: a model that works is right on every test row.
    base = orders_base(catalog).withColumn("orders__hint", F.col(TARGET) * 2.0)
    trees, joins = _given_tree(spark, CHAIN[:2], GIVEN[:6] + ["orders__hint"])
    found = evaluate.evaluate_tree(catalog, base, TARGET, trees, joins, 1, "GBM")[0]
    return _reaches(rounded(found.select("tree_id", "model", "rank", "accuracy"), "rank"), 1.05)


def f9_best_result(spark, sf):
    return rounded(evaluate.best_result(_rule_results(spark, sf)[0]), "rank", "accuracy")


def f10_explain_result(spark, sf):
    results, importances = _rule_results(spark, sf)
    return rounded(evaluate.explain_result(results, importances, 2, "RULE"), "accuracy", "importance")


def f11_importance_by_table(spark, sf):
    return rounded(evaluate.importance_by_table(_rule_results(spark, sf)[1], "customer"), "importance")


def f12_importance_of(spark, sf):
    return rounded(evaluate.importance_of(_rule_results(spark, sf)[1], "nation", "n_regionkey"), "importance")


def f13_add_result(spark, sf):
    results, _ = _rule_results(spark, sf)
    more = results.withColumn("model", F.lit("RULE2"))
    return rounded(evaluate.add_result(results, more), "rank", "accuracy")


def g1_augment(spark, sf):
    """Discovery, trees and evaluation in one call."""
    a = Augmenter(spark, catalog=Catalog.from_parquet_dir(spark, sf, ["customer", "nation", "orders"]))
    a.set_base_frame("orders", orders_base(a.catalog), TARGET)
    return a.augment_dataset(algorithm="LR", top_k_trees=1, use_cache=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    marks = tuple(f"{letter}{n}" for letter in "abcdefg" for n in range(1, 23))
    return {name: fn for name, fn in globals().items()
            if callable(fn) and name.split("_")[0] in marks}
