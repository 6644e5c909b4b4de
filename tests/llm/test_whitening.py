import math

import numpy as np
import pytest

from joingrove.llm import whitening


def random_symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    q = q.astype(np.longdouble)
    for _ in range(3):  # orthonormal in the higher precision too
        q = q + q @ ((np.eye(len(values)) - q.T @ q) / 2)
    return ((q * np.array(values, np.longdouble)) @ q.T), q


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], list(np.geomspace(1e6, 1e-6, 40)), [1] * 20, [3, 3, 3, 2, 2, 1], [1 + 1e-9 * i for i in range(12)] + [0.5] * 5,
    [1, 1 - 1e-13, 1 - 2e-13, 0.3, 0.3 + 1e-11, 0, 0], list(range(64, 0, -1)), [7.0], [2, 0]])
def test_eigenvectors_to_double_precision(values):
    a, _ = random_symmetric(values)
    got, x = whitening.refined_eigenvectors(a)
    assert np.allclose(got, sorted(map(float, values), reverse=True), rtol=0, atol=4e-16 * max(values) * len(values))
    x = x.astype(np.longdouble)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 4e-16 * max(len(values), 4)
    residual = np.abs(a @ x - x * got.astype(np.longdouble)).max()
    assert residual < 4e-16 * max(values) * max(len(values), 4)


def test_more_digits_than_single_precision_has():
    a, q = random_symmetric([8, 5, 3, 2, 1, 0.5])
    _, x = whitening.refined_eigenvectors(a)
    assert np.abs(np.abs(x) - np.abs(q.astype(float))).max() < 1e-15
    start = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    assert np.abs(np.abs(start) - np.abs(q.astype(float))).max() > 1e-9


def slow(rows):
    """Whitened values up to sign, deviations, explained shares of all whole vectors."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(d)]
    z = np.array([[x[k] - sums[k] / n for k in range(d)] for _, x in kept])
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1], v[:, ::-1]
    return n, {i: (sum((n * x[k] - sums[k]) ** 2 for k in range(d)), [z[r] @ v[:, k] / math.sqrt(e[k]) for k in range(min(d, 32))])
               for r, (i, x) in enumerate(kept)}, e / e.sum()


def test_given_vectors_equal_brute_force(spark):
    from joingrove.llm.queries import op13_whitening
    df = op13_whitening(spark, "/root/testdata/sf0.001")
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
            if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    n, want, share = slow(rows)
    got = df.collect()
    assert len(got) == 32 * n and {r["n"] for r in got} == {n}
    sign = {}
    for r in got:
        deviation, w = want[r["vec_id"]]
        assert r["deviation"] == deviation
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-12
        assert r["identity_error"] < 1e-10
        mine, theirs = r["whitened"], w[r["component"] - 1]
        if abs(theirs) > 0.1:
            assert sign.setdefault(r["component"], mine * theirs > 0) == (mine * theirs > 0)
        assert abs(abs(mine) - abs(theirs)) < 1e-7


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0], "a"), (1, [1.0, 2.0, 3.0], "a"), (2, None, "b"), (3, [1.0, None, 2.0], "b"), (4, [nan, 1.0, 1.0], None),
            (5, [inf, 1.0, 1.0], None), (None, [0.5, 0.0, 3.0], None), (6, [], "c"), (7, [1.0, 2.0], "c"), (8, [-1.0, 0.25, 3.0], "c"),
            (9, [20.0, 0.0, 3.0], "c")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, id string, component int, n double")
    got = whitening.whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in got if r["component"] == 1) == ["1", "1", "8", "9", "None"]
    assert {r["component"] for r in got} == {1, 2, 3}
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)  # the third entry never varies
    assert all(r["identity_error"] < 1e-6 for r in got)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id in (2, 3, 4)")).count() == 0
    one = whitening.whiten(df.where("vec_id = 8")).collect()
    assert len(one) == 3 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in one)


def test_enormous_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 6 and all(r["whitened"] is not None for r in got if r["component"] == 1)


def test_deviation_beyond_a_long_is_null():
    x = np.array([[0, 1], [1 << 40, 5]], np.int64)
    sums = [int(x[:, 0].sum()), int(x[:, 1].sum())]
    assert whitening._deviations(x, 2, sums) == [None, None]
    far = whitening._deviations(x[:, 1:], 2, sums[1:])
    assert far == [16, 16]
