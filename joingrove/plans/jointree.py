"""Breadth-first growth of join trees and what can be asked of them.

The loop below walks table names and edges, a few rows each. Everything that
touches data is a Spark job of `streaming.hop`.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from joingrove import schemas
from joingrove.functions.naming import qualify, quote, short_column_label
from joingrove.operators.joins import (
    ROW_ID, Facts, key_counts, key_summary, left_join_all, left_join_one, one_row_per_key)
from joingrove.sources.catalog import Catalog
from joingrove.sources.staging import discard, stage
from joingrove.streaming import hop as hops


@dataclass(frozen=True)
class Edge:
    from_table: str
    to_table: str
    from_col: str
    to_col: str
    weight: float

    @property
    def left_key(self) -> str:
        return qualify(self.from_table, self.from_col)

    @property
    def right_key(self) -> str:
        return qualify(self.to_table, self.to_col)


@dataclass(frozen=True)
class Join:
    edge: Edge
    ratio: float
    is_bridge: bool
    hop: hops.HopResult


@dataclass(frozen=True)
class Tree:
    id: int
    begin: str
    rank: float
    features: tuple[str, ...]
    joins: tuple[Join, ...] = ()


@dataclass(frozen=True)
class Live:
    """A partial join that can still grow, and the tree it stands for."""
    partial: hops.Partial
    tree: Tree


@dataclass
class Search:
    trees: list[Tree] = field(default_factory=list)
    pruned: list[tuple[Edge, float | None]] = field(default_factory=list)


def read_edges(edges: DataFrame, min_weight: float = 0.0) -> list[Edge]:
    """The edges on the driver: one row per related column pair."""
    return sorted((Edge(**r.asDict()) for r in edges.select(*schemas.EDGES.names).collect()
                   if r["weight"] >= min_weight),
                  key=lambda e: (e.from_table, e.to_table, e.from_col, e.to_col))


def strongest(edges: list[Edge]) -> list[Edge]:
    """Heaviest edges, ties kept, by column names."""
    top = max(e.weight for e in edges)
    return [e for e in edges if e.weight == top]


class Links:
    """The edges on the driver, by the table they leave: metadata, one entry per related column pair."""

    def __init__(self, edges: list[Edge]):
        self._from: dict[str, list[Edge]] = {}
        for e in edges:
            self._from.setdefault(e.from_table, []).append(e)

    def leaving(self, table: str) -> list[Edge]:
        """Edges that leave a table."""
        return self._from.get(table, [])

    def unvisited(self, table: str, visited: set[str]) -> list[str]:
        """Neighbours of a table not visited yet, sorted (C4)."""
        return sorted({e.to_table for e in self.leaving(table)} - visited)

    def best_keys(self, table: str, to_table: str) -> list[Edge]:
        """The heaviest edges from one table to another."""
        return strongest([e for e in self.leaving(table) if e.to_table == to_table])

    def open_keys(self, table: str, visited: set[str]) -> list[str]:
        """Columns of a table that lead on to tables not visited yet."""
        return sorted({e.left_key for e in self.leaving(table) if e.to_table not in visited})

    def levels(self, start: str) -> dict[str, int]:
        """Depth of every table reachable from `start`, breadth first."""
        found, level, depth = {start: 0}, [start], 0
        while level:
            depth += 1
            level = sorted({e.to_table for t in level for e in self.leaving(t)} - found.keys())
            found.update({t: depth for t in level})
        return found


def grow(catalog: Catalog, base: str, target: str, base_frame: DataFrame, edges: DataFrame,
         options: hops.Options = hops.Options(), min_weight: float = 0.0) -> Search:
    """Grow join trees outward from the base table.

    `base_frame` is the base table with qualified columns and its row id. The
    target is no key: edges that touch it are left out.
    """
    links = Links([e for e in read_edges(edges, min_weight)
                   if (e.to_table in catalog or e.to_table == base)
                   and (base, target) not in ((e.from_table, e.from_col), (e.to_table, e.to_col))])
    features = [c for c in base_frame.columns if c not in (target, ROW_ID)]
    search = Search()
    root = Tree(0, base, 0.0, tuple(features))
    search.trees.append(root)
    first = hops.start(base_frame, target, features, links.open_keys(base, {base}), options)
    live = {base: Live(replace(first, tables=(base,)), root)}
    discovered, level = {base}, [base]
    while level:
        following = []
        for node in level:
            for name in links.unvisited(node, discovered):
                discovered.add(name)
                keys = links.best_keys(node, name)
                carry = links.open_keys(name, discovered)
                reached = {name} | {t for part in live.values() for t in part.partial.tables}
                last = not any(links.unvisited(t, discovered) for t in reached)
                before, live = live, _extend(catalog, live, keys, carry, options, last, search)
                _discard_replaced(before, live)
                if any(name in part.partial.tables for part in live.values()):
                    following.append(name)
        level = sorted(set(following))
    return search


def _discard_replaced(before: dict[str, Live], after: dict[str, Live]) -> None:
    """Removes the files of partial joins that no live one is read from any more."""
    held = {f for part in after.values() for f in part.partial.frame.inputFiles()}
    for part in before.values():
        if held.isdisjoint(part.partial.frame.inputFiles()):
            discard(part.partial.frame)


def _extend(catalog: Catalog, live: dict[str, Live], keys: list[Edge], carry: list[str],
            options: hops.Options, last: bool, search: Search) -> dict[str, Live]:
    """Join one table to every live partial join, once per tied key.

    A success or bridge replaces the partial join; a prune keeps it. A later
    tied key takes the place of an earlier one, but each success stays a tree.
    """
    right = catalog.qualified(keys[0].to_table)
    grown: dict[str, Live] = {}
    for name in sorted(live):
        before = live[name]
        for edge in keys:
            if edge.from_table not in before.partial.tables:
                grown[name] = before
                continue
            result = hops.hop(before.partial, right, edge.to_table, edge.left_key, edge.right_key,
                              carry, options, last)
            if result.partial is None:
                if result.outcome == "pruned":
                    search.pruned.append((edge, result.ratio))
                grown[name] = before
                continue
            join = Join(edge, result.ratio, result.outcome == "bridge", replace(result, partial=None))
            tree = replace(before.tree, joins=before.tree.joins + (join,))
            if result.outcome == "tree":
                tree = replace(tree, id=len(search.trees), rank=result.score,
                               features=result.partial.selected)
                search.trees.append(tree)
            grown[f"{name}--{edge.to_table}"] = Live(result.partial, tree)
    return grown


# -- the trees as tables -----------------------------------------------------


def _join_keys(tree: Tree) -> list[str]:
    return [k for j in tree.joins for k in (j.edge.left_key, j.edge.right_key)]


def trees_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    return spark.createDataFrame(
        [(t.id, t.begin, float(t.rank), list(t.features), _join_keys(t)) for t in trees],
        schemas.TREES)


def tree_joins_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    return spark.createDataFrame(
        [(t.id, i, j.edge.from_table, j.edge.to_table, j.edge.from_col, j.edge.to_col,
          j.ratio, j.is_bridge) for t in trees for i, j in enumerate(t.joins)],
        schemas.TREE_JOINS)


def score_rows(hop: hops.HopResult, tree_id: int, join_idx: int) -> list[tuple]:
    """feature_scores rows of a hop: a feature is selected in both kinds iff
    its redundancy score kept it (C14)."""
    final = {f for f, _ in hop.red}
    rows = [(tree_id, join_idx, f, "rel", float(v), f in final)
            for f, v in hop.rel + hop.rel_discarded]
    return rows + [(tree_id, join_idx, f, "red", float(v), f in final)
                   for f, v in hop.red + hop.red_discarded]


def feature_scores_table(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    return spark.createDataFrame(
        [r for t in trees for i, j in enumerate(t.joins) for r in score_rows(j.hop, t.id, i)],
        schemas.FEATURE_SCORES)


def top_trees(trees: DataFrame, k: int | None = None) -> DataFrame:
    """Trees by rank, best first (C17)."""
    ordered = trees.orderBy(F.desc("rank"), "tree_id")
    return ordered if k is None else ordered.limit(k)


def tree_by_id(trees: DataFrame, tree_id: int) -> DataFrame:
    """The tree of an id; empty if absent."""
    return trees.filter(F.col("tree_id") == tree_id)


def tree_nodes(trees: DataFrame, tree_joins: DataFrame, top_k: int | None = None,
               tree_id: int | None = None) -> DataFrame:
    """Edges of trees with node numbers in join order, the base being 0, and
    short labels (C21)."""
    chosen = tree_by_id(trees, tree_id) if tree_id is not None else top_trees(trees, top_k)
    nodes = tree_joins.select("tree_id", F.col("to_table").alias("from_table"),
                              (F.col("join_idx") + 1).alias("from_node"))
    label = F.concat(short_column_label(F.col("from_col")), F.lit(" -> "),
                     short_column_label(F.col("to_col")))
    return (tree_joins.join(chosen.select("tree_id", "rank"), "tree_id")
            .join(nodes, ["tree_id", "from_table"], "left")
            .select("tree_id", "rank", F.coalesce("from_node", F.lit(0)).alias("from_node"),
                    (F.col("join_idx") + 1).alias("to_node"), "from_table", "to_table",
                    label.alias("label"))
            .orderBy(F.desc("rank"), "tree_id", "to_node"))


def tree_summary(trees: DataFrame, tree_joins: DataFrame, tree_id: int) -> DataFrame:
    """Rank, base and joins with their ratio; one row per join."""
    return (tree_by_id(trees, tree_id).select("tree_id", "begin", "rank")
            .join(tree_joins, "tree_id", "left")
            .select("tree_id", "begin", "rank", "join_idx", "from_table", "from_col", "to_table",
                    "to_col", "non_null_ratio"))


def remove_table(trees: DataFrame, tree_joins: DataFrame, feature_scores: DataFrame,
                 tree_id: int, table: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tree without a table, the tables that hang below it and their features (C20)."""
    here = F.col("tree_id") == tree_id
    gone, kept, lost_hops = {table}, [], []
    for r in tree_joins.filter(here).orderBy("join_idx").collect():
        if r["to_table"] == table or r["from_table"] in gone:
            gone.add(r["to_table"])
            lost_hops.append(r["join_idx"])
        else:
            kept += [qualify(r["from_table"], r["from_col"]), qualify(r["to_table"], r["to_col"])]
    dropped = here & F.col("join_idx").isin(lost_hops)
    lost = [r["feature"] for r in feature_scores.filter(dropped & F.col("selected"))
            .select("feature").distinct().collect()]

    def texts(values: list[str]):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    trees = trees.withColumn("features", F.when(
        here, F.array_except("features", texts(lost))).otherwise(F.col("features"))).withColumn(
        "join_keys", F.when(here, texts(kept)).otherwise(F.col("join_keys")))
    return trees, tree_joins.filter(~dropped), feature_scores.filter(~dropped)


def known_facts(trees: list[Tree]) -> dict[tuple, Facts]:
    """What the search knows of every join it ran, by edge; what holds in all trees that run it."""
    found: dict[tuple, Facts] = {}
    for join in (j for t in trees for j in t.joins):
        key, now = _edge_key(join.edge), join.hop.facts
        before = found.get(key, now)
        found[key] = Facts(tuple(dict.fromkeys(before.hot + now.hot)), max(before.salts, now.salts),
                           before.unique and now.unique)
    return found


def _edge_key(edge: Edge) -> tuple:
    return edge.from_table, edge.to_table, edge.from_col, edge.to_col


def replay(catalog: Catalog, base_frame: DataFrame, joins: list[Edge], dedupe: bool = True,
           balance: bool = True, hot: dict[tuple, Facts] | None = None) -> DataFrame:
    """Left joins of a tree, in order. With `dedupe` every base row stays one
    row. With `balance` the hot keys of each join are spread; those not known
    in `hot` are measured first, on what the joins before have written."""
    frame, total = base_frame, None
    for edge in joins:
        right = catalog.qualified(edge.to_table)
        if not dedupe:
            frame = left_join_all(frame, edge.left_key, right, edge.right_key)
            continue
        facts = (hot or {}).get(_edge_key(edge))
        if facts is None and balance:
            total = base_frame.count() if total is None else total
            if frame is not base_frame:
                frame = stage(frame, "replay")
            facts = key_summary(key_counts(frame, edge.left_key), total, right, edge.right_key).facts
        facts = facts or Facts()
        frame = left_join_one(frame, edge.left_key, one_row_per_key(right, edge.right_key, unique=facts.unique),
                              edge.right_key, list(facts.hot), facts.salts)
    return frame


def materialise(catalog: Catalog, base_frame: DataFrame, target: str, trees: DataFrame,
                tree_joins: DataFrame, tree_id: int, dedupe: bool = True,
                include_target: bool = False, keep: list[str] | None = None,
                balance: bool = True, hot: dict[tuple, Facts] | None = None) -> DataFrame:
    """The augmented table of a tree, projected to its features."""
    tree = tree_by_id(trees, tree_id).first()
    if tree is None:
        raise ValueError(f"no tree {tree_id}")
    frame = replay(catalog, base_frame, joins_of(tree_joins, tree_id), dedupe, balance, hot)
    columns = (keep or []) + ([target] if include_target else []) + list(tree["features"])
    return frame.selectExpr(*[quote(c) for c in dict.fromkeys(columns)])


def joins_of(tree_joins: DataFrame, tree_id: int) -> list[Edge]:
    rows = tree_joins.filter(F.col("tree_id") == tree_id).orderBy("join_idx").collect()
    return [Edge(r["from_table"], r["to_table"], r["from_col"], r["to_col"], 0.0) for r in rows]
