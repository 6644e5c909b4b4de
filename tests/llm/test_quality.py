from zlib import crc32

import numpy as np

from joingrove.llm import quality, queries
from tests.llm.conftest import plain


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(0)
    x0, x1 = rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (500, 3))
    n = np.array([300.0, 500.0])
    model = quality.discriminant(n, np.stack([x0.sum(0), x1.sum(0)]), np.stack([x0.T @ x0, x1.T @ x1]))
    for m, w in zip(model.means, model.whiten):
        cov = np.linalg.inv(w.T @ w)
        z = rng.normal(size=3)
        assert np.isclose(((z - m) @ w.T) @ ((z - m) @ w.T), (z - m) @ np.linalg.inv(cov) @ (z - m))
    assert model.score(x1).mean() > model.score(x0).mean()
    own = np.cov(x1.T, bias=True)
    assert np.allclose(np.linalg.inv(model.whiten[1].T @ model.whiten[1]), own, atol=0.1 * own.max())


def test_missing_classes():
    d = 3
    one = quality.discriminant(np.array([0.0, 5.0]), np.zeros((2, d)), np.zeros((2, d, d)))
    none = quality.discriminant(np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d)))
    assert one.score(np.zeros((2, d))).tolist() == [1, 1] and none.score(np.zeros((1, d))).tolist() == [0.5]


def test_constant_features():
    x = np.ones((10, 2))
    model = quality.discriminant(np.array([10.0, 10.0]), np.stack([x.sum(0), 2 * x.sum(0)]), np.stack([x.T @ x, 4 * x.T @ x]))
    assert model.score(x).max() < 0.5 < model.score(2 * x).min()


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    y = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op8_quality(spark, sf).join(y, "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    assert len(rows) > 500 and np.mean(right) > 0.98


def test_query_rows(spark):
    rows = queries.op8_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    for r in rows:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 1), (5, 1), (6, 0), (None, 1), (8, None)], "doc_id long, quality int")
    rows = plain(quality.score_quality(odd_docs, labels))
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(no_docs, labels).count() == 0
    assert all(np.isfinite(quality.statistics(t)).all() for t in (None, "", " ", "\n\n", "x", "!" * 5000))
