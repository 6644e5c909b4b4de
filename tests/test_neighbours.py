import random

import numpy as np
import pytest

from joingrove.operators import neighbours as N
from joingrove.operators.models import algorithms


def frame(spark, rows):
    return spark.createDataFrame([(float(y), [float(x) for x in v]) for y, v in rows], "label double, v array<double>")


def index(spark, rows, **sizes):
    train = frame(spark, rows).groupBy("v").agg({"label": "sum", "*": "count"}).withColumnRenamed("sum(label)", "s").withColumnRenamed("count(1)", "n")
    return N.Neighbours(train, **sizes)


def slow(rows, asked):
    """For each asked vector the distances of the five nearest distinct vectors, and the vote of the five nearest rows."""
    vectors = {}
    for y, v in rows:
        n, s = vectors.get(tuple(v), (0, 0))
        vectors[tuple(v)] = (n + 1, s + y)
    known = np.array(list(vectors))
    mean, deviation = known.mean(0), known.std(0, ddof=1) if len(known) > 1 else np.ones(known.shape[1])
    deviation = np.where(np.nan_to_num(deviation) == 0, 1, deviation)
    z, out = (known - mean) / deviation, []
    counts = list(vectors.values())
    for v in asked:
        away = np.sqrt((((np.array(v) - mean) / deviation - z) ** 2).sum(1))
        order = np.argsort(away, kind="stable")
        rows_, positive = 0, 0.0
        for i in order:
            take = min(counts[i][0], 5 - rows_)
            rows_, positive = rows_ + take, positive + take * counts[i][1] / counts[i][0]
        out.append((sorted(away)[:5], float(positive * 2 > rows_ + 1e-9)))
    return out


def numbers(rng, n, dims):
    return [(int(sum(v) + rng.gauss(0, 0.7) > 0), v) for v in ([rng.gauss(0, 1) for _ in range(dims)] for _ in range(n))]


@pytest.mark.parametrize("n,dims,sizes", [(1500, 6, {}), (800, 2, {"pivots": 20, "block": 30}), (400, 12, {"pivots": 7, "block": 50}),
                                          (3, 2, {}), (5, 1, {"pivots": 2}), (60, 3, {"pivots": 60})])
def test_neighbours_equal_brute_force(spark, n, dims, sizes):
    rng = random.Random(n)
    rows = numbers(rng, n, dims)
    rows += [(1 - y, v) for y, v in rows[:n // 10]] + [rows[0]] * 7  # copies with other labels, and a crowd
    asked = [v for _, v in numbers(rng, 150, dims)] + [rows[0][1], rows[-1][1]]
    want = slow(rows, asked)
    got = {r["qid"]: r for r in index(spark, rows, **sizes).of(spark.createDataFrame(list(enumerate(asked)), "qid long, v array<double>"))
           .select("qid", "top", N.vote("top").alias("p")).collect()}
    assert len(got) == len(asked)
    for i, (away, vote) in enumerate(want):
        assert [t["distance"] for t in got[i]["top"]] == pytest.approx(away, abs=1e-9)
        assert got[i]["p"] == vote


def test_labels_that_only_the_nearest_rows_know(spark):
    """Labels alternate from cell to cell of a grid: a vote of other than the nearest rows is chance."""
    rng = random.Random(2)
    rule = lambda v: (int(v[0] * 6) + int(v[1] * 6) + int(v[2] * 6)) % 2
    points = [[rng.random() for _ in range(3)] for _ in range(9000)]
    asked = [[(rng.randrange(6) + 0.5) / 6 + rng.uniform(-0.03, 0.03) for _ in range(3)] for _ in range(300)]
    model = algorithms("KNN")[0].fit(frame(spark, [(rule(v), v) for v in points]))
    right = [r["prediction"] == r["label"] for r in model(frame(spark, [(rule(v), v) for v in asked])).collect()]
    assert len(right) == 300 and sum(right) / 300 > 0.95


def test_odd_rows(spark):
    model = algorithms("KNN")[0].fit(frame(spark, [(1, [1.0, 1.0])] * 3 + [(0, [1.0, 1.0])]))
    asked = frame(spark, [(0, [5.0, 5.0]), (0, [1.0, 1.0]), (0, [1.0, 1.0])])
    assert [r["prediction"] for r in model(asked).collect()] == [1.0] * 3
    assert model(asked.limit(0)).count() == 0
    without_features = algorithms("KNN")[0].fit(frame(spark, [(1, []), (1, []), (0, [])]))
    assert without_features(frame(spark, [(0, [])])).first()["prediction"] == 1.0
    nothing = algorithms("KNN")[0].fit(frame(spark, []))
    assert nothing(asked).first()["prediction"] == 0.0
