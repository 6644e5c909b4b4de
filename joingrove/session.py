"""`Augmenter`: the four stages and the edits between them.

State is a handful of small tables: edges, trees, tree_joins, feature_scores,
results and importances. An edit replaces the table it changes and marks what
depends on it as stale; a stale table is computed again when it is next read
(B16).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from joingrove import schemas
from joingrove.functions.naming import qualify, short_table_label
from joingrove.operators import curate, edges as E, evaluate, matchers
from joingrove.operators.joins import ROW_ID
from joingrove.plans import jointree
from joingrove.sources import edge_files
from joingrove.sources.catalog import LINK_FILE, Catalog, read_links
from joingrove.sources.staging import stage, staging_root
from joingrove.streaming.hop import Options


class Augmenter:
    """Feature discovery for one base table.

    `root` is a folder of datasets (folders of CSV or parquet tables); a ready
    `catalog` may be given instead.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, catalog: Catalog | None = None,
                 options: Options = Options(), cache_root: str | None = None):
        self.spark = spark
        self.root = root
        self.options = options
        self.cache_root = cache_root
        self.catalog = catalog or Catalog(spark)
        self.base_table: str | None = None
        self.target: str | None = None
        self._base: DataFrame | None = None
        self._excluded: set[str] = set()
        self._added: set[str] = set()      # tables that stay when the repository changes
        self._edges: DataFrame | None = None
        self.malformed_relationships: DataFrame | None = None
        self._match: dict | None = None
        self._edges_stale = False
        self._trees: DataFrame | None = None
        self._tree_joins: DataFrame | None = None
        self._scores: DataFrame | None = None
        self._trees_stale = False
        self._results: DataFrame | None = None
        self._importances: DataFrame | None = None
        self._evaluation: dict | None = None
        self._results_stale = False
        self.search: jointree.Search | None = None

    # -- tables -------------------------------------------------------------

    def set_base_table(self, base_table: str, target_column: str, row_key: str | None = None) -> None:
        """Base table and target; all other columns are its features (A4).

        A table that is not in the repository yet is looked up below the root.
        `row_key` names a column that identifies a row. Without one, ids are
        written once beside the table.
        """
        if base_table not in self.catalog:
            if self.root is None:
                raise ValueError(f"no table {base_table!r}; add it or give the augmenter a root folder")
            self._add(base_table, f"{self.root}/{base_table}")
        self.base_table, self.target = base_table, target_column
        frame = self.catalog.qualified(base_table, target_column)
        if row_key is not None:
            key = row_key if row_key == target_column else qualify(base_table, row_key)
            self._base = frame.withColumn(ROW_ID, F.col(f"`{key}`"))
        else:
            self._base = stage(frame.withColumn(ROW_ID, F.monotonically_increasing_id()), "base-rows")
        self._stale_trees()

    def set_base_frame(self, base_table: str, frame: DataFrame, target_column: str) -> None:
        """A base table that is already a DataFrame with qualified names and a row id."""
        self.base_table, self.target, self._base = base_table, target_column, frame
        self._stale_trees()

    @property
    def base_frame(self) -> DataFrame:
        if self._base is None:
            raise ValueError("set the base table first")
        return self._base

    @property
    def base_features(self) -> list[str]:
        return [c for c in self.base_frame.columns if c not in (self.target, ROW_ID)]

    def set_dataset_repository(self, dataset_repository: list[str] | None = None,
                               all_tables: bool = False) -> None:
        """Chooses the datasets below the root (A5). The base table and tables
        added before stay; relationships and trees are computed again when next read."""
        if self.root is None:
            raise ValueError("give the augmenter a root folder to choose datasets from")
        kept = self.catalog.only([*self._added, *([self.base_table] if self.base_table else [])])
        self.catalog = Catalog.from_repository(self.spark, self.root, dataset_repository, all_tables).merged(kept)
        self._stale_edges()

    def get_tables_repository(self) -> list[str]:
        """Names of the tables in play."""
        return [n for n in self.catalog.names if n not in self._excluded]

    def tables(self) -> DataFrame:
        return self._active().tables()

    def add_table(self, table: str, path: str | None = None, format: str | None = None) -> None:
        """Adds a table (A7). Where relationships were matched before, those with
        the new table join them; edits to the others stay."""
        known = self._edges if self._match is not None and not self._edges_stale else None
        replaced = table in self.catalog
        self._add(table, path or f"{self.root}/{table}", format)
        if known is None:
            self._stale_edges()
            return
        m = self._match
        found = matchers.find_relationships(self._active(), m["threshold"], m["matcher"], m["instances"], table=table)
        known = E.without_table(known, table) if replaced else known
        self._edges = stage(known.unionByName(found), "edges")
        self._stale_trees()

    def _add(self, table: str, path: str, format: str | None = None) -> None:
        self.catalog = self.catalog.add(table, path, format or (
            "csv" if path.endswith(".csv") else "parquet"))
        self._added.add(table)
        self._excluded.discard(table)

    def _stale_edges(self) -> None:
        if self._match is not None:
            self._edges_stale = True
        self._stale_trees()

    def remove_table(self, table: str) -> None:
        """Excludes a table; its edges go without a rescan."""
        self._excluded.add(table)
        if self._edges is not None:
            self._edges = E.without_table(self._edges, table)
        self._stale_trees()

    def _active(self) -> Catalog:
        catalog = self.catalog
        for name in self._excluded:
            catalog = catalog.remove(name)
        return catalog

    # -- relationships --------------------------------------------------------

    def find_relationships(self, matcher: str = "coma", relationship_threshold: float = 0.5,
                           use_cache: bool = True, instances: bool = False) -> DataFrame:
        """Column relationships over all table pairs (B6); saved ones are used
        only with `use_cache`, and only for the same tables in the same state.
        They outlast the session in `cache_root`."""
        self._match = {"matcher": matcher, "threshold": relationship_threshold,
                       "instances": instances, "use_cache": use_cache}
        path = edge_files.cache_path(self.cache_root or staging_root(self.spark),
                                     self.base_table or "any", relationship_threshold,
                                     f"{matcher}-instances" if instances else matcher,
                                     self._active().states())
        found = edge_files.load_edges(self.spark, path) if use_cache else None
        if found is None:
            found = matchers.find_relationships(self._active(), relationship_threshold, matcher, instances)
            if use_cache:
                edge_files.save_edges(found, path)
                found = edge_files.load_edges(self.spark, path)
            else:
                found = stage(found, "edges")
        self._edges, self._edges_stale = found, False
        self._stale_trees()
        return found

    def read_relationships(self, file_path: str) -> DataFrame:
        """Loads saved edges in text form (A9); records that are none are left in
        `malformed_relationships`."""
        self._edges, self.malformed_relationships = edge_files.read_edge_text(self.spark, file_path)
        self._edges_stale, self._match = False, None
        self._stale_trees()
        return self._edges

    def write_relationships(self, file_path: str) -> None:
        """Saves the edges in text form (A10)."""
        edge_files.write_edge_text(self.edges, file_path)

    def read_known_links(self, dataset: str) -> DataFrame:
        """The links that a dataset's link file names, in both directions, as
        the edges (A12). Links of tables that are not there stay out."""
        links = read_links(self.spark, f"{self.root}/{dataset}/{LINK_FILE}", dataset)
        names = self.get_tables_repository()
        there = F.col("from_table").isin(names) & F.col("to_table").isin(names)
        self.set_relationships(E.both_directions(links.filter(there)))
        return self._edges

    def set_relationships(self, edges: DataFrame) -> None:
        self._edges, self._edges_stale, self._match = edges, False, None
        self._stale_trees()

    @property
    def edges(self) -> DataFrame:
        if self._edges_stale:
            m = self._match
            self.find_relationships(m["matcher"], m["threshold"], m["use_cache"], m["instances"])
        if self._edges is None:
            return self.spark.createDataFrame([], schemas.EDGES)
        return self._edges

    def get_weights_from_table(self, table: str) -> DataFrame:
        return E.edges_from(self.edges, table)

    def get_weights_from_and_to_table(self, from_table: str, to_table: str) -> DataFrame:
        return E.edges_between(self.edges, from_table, to_table)

    def get_best_weight(self, table1: str, table2: str) -> DataFrame:
        return E.best_edges(E.edges_between(self.edges, table1, table2))

    def display_best_relationships(self) -> DataFrame:
        """Table by table matrix of best weights."""
        return E.weight_matrix(self.edges, self.get_tables_repository())

    def display_table_relationship(self, table1: str, table2: str) -> DataFrame:
        """Column by column matrix of two tables."""
        columns = [c for _, t, c, _ in self.catalog.column_list() if t == table2]
        return E.column_matrix(self.edges, table1, table2, columns)

    def explain_relationship(self, table1: str, table2: str) -> DataFrame:
        return E.edges_of_pair(self.edges, table1, table2)

    def table_labels(self) -> DataFrame:
        """Short labels of the tables."""
        return self._active().tables().select("name", short_table_label(F.col("name")).alias("label"))

    def add_relationship(self, table1: str, col1: str, table2: str, col2: str, weight: float) -> None:
        self._edges = E.add_edge(self.edges, table1, col1, table2, col2, weight)
        self._stale_trees()

    def remove_relationship(self, table1: str, col1: str, table2: str, col2: str) -> None:
        self._edges = E.remove_edge(self.edges, table1, col1, table2, col2)
        self._stale_trees()

    def update_relationship(self, table1: str, col1: str, table2: str, col2: str, weight: float) -> None:
        self._edges = E.update_edge(self.edges, table1, col1, table2, col2, weight)
        self._stale_trees()

    # -- trees ------------------------------------------------------------------

    def compute_join_trees(self, top_k_features: int = 10, non_null_threshold: float = 0.5) -> DataFrame:
        """Grows join trees from the base table."""
        self.options = replace(self.options, top_k=top_k_features, non_null_threshold=non_null_threshold)
        self.search = jointree.grow(self._active(), self.base_table, self.target, self.base_frame,
                                    self.edges, self.options)
        found = self.search.trees
        self._trees = jointree.trees_table(self.spark, found)
        self._tree_joins = jointree.tree_joins_table(self.spark, found)
        self._scores = jointree.feature_scores_table(self.spark, found)
        self._trees_stale = False
        self._results_stale = self._results is not None
        return self._trees

    def _fresh_trees(self) -> None:
        if self._trees_stale:
            self.compute_join_trees(self.options.top_k, self.options.non_null_threshold)
        if self._trees is None:
            raise ValueError("compute the join trees first")

    def _stale_trees(self) -> None:
        self._trees_stale = self._trees is not None
        self._results_stale = self._results is not None

    def _hot_keys(self) -> dict:
        return jointree.known_facts(self.search.trees) if self.search else {}

    @property
    def trees(self) -> DataFrame:
        self._fresh_trees()
        return self._trees

    @property
    def tree_joins(self) -> DataFrame:
        self._fresh_trees()
        return self._tree_joins

    @property
    def feature_scores(self) -> DataFrame:
        self._fresh_trees()
        return self._scores

    def get_tree_by_id(self, tree_id: int) -> DataFrame:
        return jointree.tree_by_id(self.trees, tree_id)

    def display_join_trees(self, top_k: int | None = None) -> DataFrame:
        return jointree.tree_nodes(self.trees, self.tree_joins, top_k)

    def display_join_tree(self, tree_id: int) -> DataFrame:
        return jointree.tree_nodes(self.trees, self.tree_joins, tree_id=tree_id)

    def explain_tree(self, tree_id: int) -> DataFrame:
        return jointree.tree_summary(self.trees, self.tree_joins, tree_id)

    def inspect_join_tree(self, tree_id: int) -> tuple[DataFrame, DataFrame]:
        return self.explain_tree(tree_id), self.show_features(tree_id)

    def remove_join_path_from_tree(self, tree_id: int, table: str) -> None:
        self._fresh_trees()
        self._trees, self._tree_joins, self._scores = jointree.remove_table(
            self._trees, self._tree_joins, self._scores, tree_id, table)

    def materialise_join_tree(self, tree_id: int, dedupe: bool = True,
                              include_target: bool = False) -> DataFrame:
        return jointree.materialise(self._active(), self.base_frame, self.target, self.trees,
                                    self.tree_joins, tree_id, dedupe, include_target,
                                    hot=self._hot_keys())

    # -- features -----------------------------------------------------------------

    def show_features(self, tree_id: int, show_discarded_features: bool = False) -> DataFrame:
        return curate.show_features(self.feature_scores, self.tree_joins, tree_id,
                                    selected=not show_discarded_features)

    def adjust_relevance_value(self, tree_id: int, feature: str, value: float) -> None:
        self._scores = curate.adjust_relevance(self.feature_scores, tree_id, feature, value)
        self._results_stale = self._results is not None

    def adjust_redundancy_value(self, tree_id: int, feature: str, value: float) -> None:
        self._scores = curate.adjust_redundancy(self.feature_scores, tree_id, feature, value)
        self._results_stale = self._results is not None

    def adjust_non_null_ratio(self, tree_id: int, table: str, value: float) -> None:
        self._tree_joins = curate.adjust_non_null_ratio(self.tree_joins, tree_id, table, value)
        self._results_stale = self._results is not None

    def move_features_to_discarded(self, tree_id: int, features: list[str]) -> None:
        self._trees, self._scores = curate.move_to_discarded(
            self.trees, self.feature_scores, tree_id, features)

    def move_features_to_selected(self, tree_id: int, features: list[str]) -> None:
        self._trees, self._scores = curate.move_to_selected(
            self.trees, self.feature_scores, tree_id, features)

    # -- results --------------------------------------------------------------------

    def evaluate_trees(self, algorithm: str | None = "GBM", top_k_trees: int = 3) -> DataFrame:
        """Models on the best trees."""
        self._evaluation = {"algorithm": algorithm, "top_k": top_k_trees, "tree_id": None}
        self._results, self._importances = evaluate.evaluate_trees(
            self._active(), self.base_frame, self.target, self.trees, self.tree_joins,
            top_k_trees, algorithm, self._hot_keys())
        self._results_stale = False
        return self._results

    def evaluate_augmented_table(self, tree_id: int, algorithm: str | None = "GBM") -> DataFrame:
        """Models on one tree, in place of earlier results (F8)."""
        self._evaluation = {"algorithm": algorithm, "top_k": None, "tree_id": tree_id}
        self._results, self._importances = evaluate.evaluate_tree(
            self._active(), self.base_frame, self.target, self.trees, self.tree_joins,
            tree_id, algorithm, self._hot_keys())
        self._results_stale = False
        return self._results

    def _fresh_results(self) -> None:
        if self._results is None:
            raise ValueError("evaluate trees first")
        if self._results_stale:
            again = self._evaluation
            if again["tree_id"] is None:
                self.evaluate_trees(again["algorithm"], again["top_k"])
            else:
                self.evaluate_augmented_table(again["tree_id"], again["algorithm"])

    @property
    def results(self) -> DataFrame:
        self._fresh_results()
        return self._results

    @property
    def importances(self) -> DataFrame:
        self._fresh_results()
        return self._importances

    def add_result(self, results: DataFrame, importances: DataFrame | None = None) -> None:
        self._results = evaluate.add_result(self.results, results)
        if importances is not None:
            self._importances = evaluate.add_result(self._importances, importances)

    def get_best_result(self) -> DataFrame:
        return evaluate.best_result(self.results)

    def explain_result(self, tree_id: int, model: str = "GBM") -> DataFrame:
        return evaluate.explain_result(self.results, self.importances, tree_id, model)

    def get_feature_importance(self, table: str | None = None, column: str | None = None) -> DataFrame:
        return evaluate.importance_of(self.importances, table, column)

    # -- all of it ------------------------------------------------------------------

    def augment_dataset(self, algorithm: str | None = "GBM", relationship_threshold: float = 0.5,
                        non_null_threshold: float = 0.5, matcher: str = "coma",
                        top_k_features: int = 10, top_k_trees: int = 3,
                        use_cache: bool = True) -> DataFrame:
        """Relationships, trees and results in sequence (G1)."""
        self.find_relationships(matcher, relationship_threshold, use_cache)
        self.compute_join_trees(top_k_features, non_null_threshold)
        return self.evaluate_trees(algorithm, top_k_trees)
