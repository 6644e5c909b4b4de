"""The nearest training rows of each asked row, exactly.

Training vectors are dealt to the nearest of some pivots. A row first looks at the cells nearest to it until they hold
enough vectors. The distance of the last one found bounds the search: by the triangle inequality a cell whose
pivot, radii or border lie farther away than that cannot hold a nearer vector, and all others are visited. Cells
and the rows that visit them are cut into blocks, so no task holds more than two of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from joingrove.sources.shipping import ship
from joingrove.sources.staging import stage

NEIGHBOURS = 5
PIVOTS = 256
# Vectors of a cell, and rows that visit it, which one task compares; and rows compared at once.
BLOCK, TOGETHER = 20_000, 64
FOUND = "qid long, distance double, key long, n long, s double"


def scaling(vectors: DataFrame, dims: int) -> tuple[list[float], list[float]]:
    """Mean and standard deviation of each entry; a deviation of 0 counts as 1."""
    if not dims:
        return [], []
    row = vectors.agg(*[F.avg(F.col("v")[i]).alias(f"a{i}") for i in range(dims)],
                      *[F.stddev(F.col("v")[i]).alias(f"d{i}") for i in range(dims)]).first()
    return [row[f"a{i}"] or 0.0 for i in range(dims)], [row[f"d{i}"] or 1.0 for i in range(dims)]


def _rows(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float).reshape(len(vectors), dims)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By differences, not products: equal vectors are at 0 and ties are ties."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(out)


class Neighbours:
    """An index of training vectors: `train` has v (array<double>), n rows of it and their sum of labels s, each v once."""

    def __init__(self, train: DataFrame, pivots: int = PIVOTS, block: int = BLOCK) -> None:
        self.spark, self.block = train.sparkSession, block
        ship(self.spark)
        first = train.select(F.size("v").alias("d")).first()
        self.dims = dims = first["d"] if first else 0
        self.scale = mean, deviation = scaling(train, dims)
        scaled = lambda v: (_rows(v, dims) - np.array(mean)) / np.array(deviation)
        self._scaled = scaled
        sample = train.orderBy(F.xxhash64("v"), "v").limit(pivots).toPandas() if first else pd.DataFrame({"v": []})
        self.pivots = centres = scaled(sample["v"])

        def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                z = scaled(f["v"])
                away = _distances(z, centres)
                cell = away.argmin(1)
                yield pd.DataFrame({"key": f["key"].to_numpy(), "z": pd.Series(list(z), dtype=object), "n": f["n"].to_numpy(), "s": f["s"].to_numpy(), "cell": cell, "away": away[np.arange(len(z)), cell]})

        keyed = train.select("v", F.xxhash64("v").alias("key"), F.col("n").cast("long").alias("n"), F.col("s").cast("double").alias("s"))
        self.points = stage(keyed.mapInPandas(dealt, "key long, z array<double>, n long, s double, cell int, away double"), "points")
        # A row per pivot.
        self.cells = {r["cell"]: (r["vectors"], r["near"], r["far"]) for r in self.points.groupBy("cell").agg(
            F.count(F.lit(1)).alias("vectors"), F.min("away").alias("near"), F.max("away").alias("far")).collect()}

    def of(self, asked: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
        """qid, top: for rows of qid and v the `k` nearest vectors as (distance, key, n, s), the nearest first.

        Without training rows there are none.
        """
        if not self.cells:
            return asked.select("qid", F.expr("cast(array() AS array<struct<distance:double,key:bigint,n:bigint,s:double>>)").alias("top"))
        asked = stage(asked.select("qid", "v"), "asked")
        first = self._merged(self._visits(asked.mapInPandas(self._nearest_cells(k), "qid long, z array<double>, cell int")), k)
        first = stage(first, "first-neighbours")
        bounded = asked.join(first.select("qid", F.when(F.size("top") >= k, F.col("top")[k - 1]["distance"]).alias("bound")), "qid")
        second = self._visits(bounded.select("qid", "v", "bound").mapInPandas(self._other_cells(k), "qid long, z array<double>, cell int"))
        both = first.select("qid", F.explode("top").alias("t")).select("qid", "t.*").unionByName(second)
        return self._merged(both, k)

    def _nearest_cells(self, k: int):
        scaled, pivots, cells = self._scaled, self.pivots, self.cells

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                z = scaled(f["v"])
                yield _sent(f["qid"], z, _cells_at_first(cells, _distances(z, pivots), k))

        return run

    def _other_cells(self, k: int):
        scaled, pivots, cells = self._scaled, self.pivots, self.cells

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            present = np.array(sorted(cells), int)
            near, far = (np.array([cells[c][i] for c in present]) for i in (1, 2))
            apart = _distances(pivots[present], pivots[present])
            for f in frames:
                z = scaled(f["v"])
                away = _distances(z, pivots)
                own = away[:, present]
                bound = f["bound"].fillna(np.inf).to_numpy()[:, None] * (1 + 1e-9)
                least = np.maximum(own - far, near - own)
                # The plane midway between a cell's pivot and the row's own one.
                home = own.argmin(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (own ** 2 - own[np.arange(len(own)), home, None] ** 2) / (2 * apart[home])
                visit = np.fmax(least, plane) <= bound
                for i, done in enumerate(_cells_at_first(cells, away, k)):
                    visit[i, np.searchsorted(present, done)] = False
                yield _sent(f["qid"], z, [present[v] for v in visit])

        return run

    def _visits(self, sent: DataFrame) -> DataFrame:
        """The nearest vectors of each block that a row visits."""
        sent = stage(sent, "visits")
        # A row per pivot.
        guests = {r["cell"]: r["rows"] for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).collect()}
        if not guests:
            return self.spark.createDataFrame([], FOUND)
        blocks = self.spark.createDataFrame([(c, -(-self.cells[c][0] // self.block), -(-n // self.block)) for c, n in guests.items()],
                                            "cell int, p_blocks int, q_blocks int")
        keys = ["cell", "p", "q"]
        one = lambda key, of: F.pmod(F.xxhash64(key, F.lit(1)), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        left = sent.join(F.broadcast(blocks), "cell").select("cell", every("p_blocks").alias("p"), one("qid", "q_blocks").alias("q"), "qid", "z")
        right = self.points.join(F.broadcast(blocks), "cell").select("cell", one("key", "p_blocks").alias("p"), every("q_blocks").alias("q"), "key", "z", "n", "s")
        right, dims = right.toDF(*right.columns), self.dims
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda x, y: _nearest(x, y, dims), FOUND)

    @staticmethod
    def _merged(found: DataFrame, k: int) -> DataFrame:
        return (found.groupBy("qid").agg(F.collect_list(F.struct("distance", "key", "n", "s")).alias("all"))
                .select("qid", F.slice(F.sort_array("all"), 1, k).alias("top")))


def _cells_at_first(cells: dict, away: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its nearest cells that together hold k vectors, or all."""
    present = np.array(sorted(cells), int)
    if not len(present):
        return [present] * len(away)
    held = np.array([cells[c][0] for c in present])
    order = np.argsort(away[:, present], axis=1, kind="stable")
    total = held[order].cumsum(1)
    last = np.where(total[:, -1] >= k, (total >= k).argmax(1), len(present) - 1)
    return [present[order[i, :last[i] + 1]] for i in range(len(away))]


def _sent(qid: pd.Series, z: np.ndarray, chosen: list) -> pd.DataFrame:
    times = [len(c) for c in chosen]
    return pd.DataFrame({"qid": qid.repeat(times).to_numpy(), "z": pd.Series(list(np.repeat(z, times, axis=0)), dtype=object),
                         "cell": np.concatenate([np.asarray(c, int) for c in chosen]) if chosen else np.empty(0, int)})


def _nearest(asked: pd.DataFrame, points: pd.DataFrame, dims: int, k: int = NEIGHBOURS) -> pd.DataFrame:
    """The k nearest of the block for each row; of equally near ones those with the least keys."""
    if asked.empty or points.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in FOUND.split(", ")])
    a, b = _rows(asked["z"], dims), _rows(points["z"], dims)
    key, qid = points["key"].to_numpy(), asked["qid"].to_numpy()
    rows, near, away = [], [], []
    for i in range(0, len(a), TOGETHER):
        d = _distances(a[i:i + TOGETHER], b)
        last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        for j, row in enumerate(d):
            close = np.flatnonzero(row <= last[j])
            close = close[np.lexsort((key[close], row[close]))[:k]]
            rows.append(np.full(len(close), qid[i + j]))
            near.append(close)
            away.append(row[close])
    near = np.concatenate(near)
    return pd.DataFrame({"qid": np.concatenate(rows), "distance": np.concatenate(away), "key": key[near],
                         "n": points["n"].to_numpy()[near], "s": points["s"].to_numpy()[near]})


def vote(top: str, k: int = NEIGHBOURS) -> Column:
    """1 if more than half of the `k` nearest rows are labelled 1; of copies of one vector that go beyond k rows each counts
    for its share."""
    return F.expr(f"""aggregate({top}, named_struct('r', 0D, 'p', 0D), (a, x) -> named_struct(
        'r', a.r + least(x.n, {k} - a.r), 'p', a.p + least(x.n, {k} - a.r) * x.s / x.n),
        a -> CASE WHEN a.p * 2 > a.r + 1e-9D THEN 1D ELSE 0D END)""")
