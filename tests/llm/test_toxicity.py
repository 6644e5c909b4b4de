import pickle
import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from joingrove.llm import queries, toxicity
from tests.llm.conftest import plain

WORDS = "alpha beta gamma delta house tree river stone and the of to".split()


def sentence(rng, bad):
    words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
    if bad:
        words[rng.randrange(len(words))] = rng.choice(["Grumbly,", "FROBNIK", "zonkish!"])
    return " ".join(words)


def test_learns_planted_words():
    rng = random.Random(1)
    docs = [(sentence(rng, i % 6 == 0), int(i % 6 == 0)) for i in range(600)]
    net = toxicity.train_calibrated([toxicity.word_places(t) for t, _ in docs[:400]], np.array([y for _, y in docs[:400]]))
    got = net.score([toxicity.word_places(t) for t, _ in docs[400:]]) >= 0.5
    assert (got == [bool(y) for _, y in docs[400:]]).mean() >= 0.98
    again = toxicity.train_calibrated([toxicity.word_places(t) for t, _ in docs[:400]], np.array([y for _, y in docs[:400]]))
    assert np.array_equal(net.out, again.out)


def test_a_network_is_sent_by_the_rows_that_the_fit_moved():
    rng = random.Random(5)
    docs, y = [toxicity.word_places(sentence(rng, i % 3 == 0)) for i in range(90)], np.arange(90) % 3 == 0
    for net in (toxicity.train_calibrated(docs, y), toxicity.train_calibrated(docs, y * 0), toxicity.train_calibrated([], np.zeros(0))):
        sent = pickle.dumps(net)
        back = pickle.loads(sent)
        assert len(sent) < 100_000
        assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(net.tables, back.tables, strict=True))
        assert np.array_equal(net.raw(docs)[0], back.raw(docs)[0]) and np.array_equal(net.score(docs), back.score(docs))


def test_training_lowers_the_loss(monkeypatch):
    rng = random.Random(2)
    docs, y = [toxicity.word_places(sentence(rng, i % 2)) for i in range(80)], np.arange(80) % 2
    loss = []
    for epochs in (0, 8, 80):
        monkeypatch.setattr(toxicity, "EPOCHS", epochs)
        logit, _ = toxicity.train(docs, y).raw(docs)
        loss.append(np.log1p(np.exp(-np.where(y == 1, logit, -logit))).mean())
    assert loss[0] > loss[1] > loss[2] and loss[2] < loss[0] / 2


def test_chunks_and_groups_do_not_change_scores(monkeypatch):
    rng = random.Random(3)
    docs = [toxicity.word_places(sentence(rng, i % 5 == 0) * (1 + 40 * (i % 7 == 0))) for i in range(60)] + [b""]
    net = toxicity.train(docs, np.arange(61) % 5 == 0)
    whole = net.score(docs)
    for chunk in (7, 50, 400):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.allclose(net.score(docs), whole, atol=1e-5)


def test_one_class_or_no_row():
    assert np.allclose(toxicity.train_calibrated([], np.zeros(0)).score([b"", toxicity.word_places("a b")]), 0.5)
    net = toxicity.train_calibrated([toxicity.word_places("a")] * 20, np.zeros(20))
    assert (net.score([toxicity.word_places("a"), b""]) < 0.1).all()


def test_held_out_documents(spark):
    """Of the held-out rows of the given labels, by score and by decision."""
    sf = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, sf)
    y = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(y, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    score, hit, toxic = (np.array([r[i] for r in rows]) for i in range(3))
    order = score.argsort().argsort()
    n = toxic.sum()
    assert (order[toxic == 1].sum() - n * (n - 1) / 2) / (n * (len(toxic) - n)) > 0.93
    assert (hit[toxic == 0] == 1).mean() < 0.01 and (hit[toxic == 1] == 1).mean() > 0.75


def test_query_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op5_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, 0), (5, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    net = toxicity.fit(odd_docs, labels)
    rows = plain(toxicity.score_toxicity(odd_docs, net))
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(no_docs, toxicity.fit(no_docs, labels)).count() == 0
    kept = odd_docs.where(~toxicity.toxic(F.col("text"), net, spark))
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_the_fit_depends_on_rows_not_on_partitions(spark):
    rng = random.Random(6)
    rows = [(i % 40, sentence(rng, i % 4 == 0)) for i in range(200)]  # each id five times
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nets = [toxicity.fit(docs.repartition(n), labels, rows=30) for n in (1, 5, 9)]
    assert all(np.array_equal(nets[0].out, n.out) for n in nets[1:])
    few = [toxicity.fit(docs.repartition(n), labels, words=400) for n in (1, 6)]
    assert np.array_equal(few[0].out, few[1].out) and not np.array_equal(few[0].out, nets[0].out)


def plain_logit(net, places):
    """The network word by word, filter by filter, in plain loops and double precision."""
    words = np.frombuffer(places, "<u4").reshape(-1, toxicity.TABLES)
    vectors = [[float(v) for i, t in enumerate(net.tables) for v in t[w[i]]] for w in words]
    n, q, empty = len(words), toxicity.QUARTERS, [0.0] * (toxicity.TABLES * toxicity.DIM)
    at = lambda k: vectors[k] if k < n else empty
    pooled = []
    for f in net.filters:
        for column in range(toxicity.FILTERS):
            response = [sum(at(k + o)[d] * float(f[o][d][column]) for o in range(len(f)) for d in range(len(empty))) for k in range(n + q)]
            pooled.append([max(response[(n + q) * i // q:(n + q) * (i + 1) // q]) for i in range(q)])
    features = [max(m) for m in pooled] + [sum(m) / q for m in pooled]
    return sum(max(v + float(b), 0.0) * float(o) for v, b, o in zip(features, net.bias, net.out)) + float(net.offset)


def test_scores_equal_plain_loops():
    rng = random.Random(7)
    docs = [toxicity.word_places(sentence(rng, i % 3 == 0)) for i in range(14)] + [b"", toxicity.word_places("one")]
    net = toxicity.train(docs, np.arange(16) % 3 == 0)
    logit, _ = net.raw(docs)
    assert np.allclose(logit, [plain_logit(net, d) for d in docs], atol=1e-4)


def test_gradients_equal_finite_differences(monkeypatch):
    """The first step of training moves weights as the loss of the plain loops says."""
    rng = random.Random(8)
    docs, y = [toxicity.word_places(sentence(rng, i % 3 == 0)) for i in range(9)], (np.arange(9) % 3 == 0).astype(float)
    monkeypatch.setattr(toxicity, "DECAY", 0.0)
    nets = []
    for epochs in (0, 1):
        monkeypatch.setattr(toxicity, "EPOCHS", epochs)
        nets.append(toxicity.train(docs, y))
    before, after = nets
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5

    def loss():
        logit = np.array([plain_logit(before, d) for d in docs])
        return (weight * np.log1p(np.exp(-np.where(y == 1, logit, -logit)))).mean()

    def slope(weights, place, step=1e-3):
        kept = weights[place]
        ends = []
        for d in (step, -step):
            weights[place] = kept + d
            ends.append((loss(), float(weights[place])))
        weights[place] = kept
        return (ends[0][0] - ends[1][0]) / (ends[0][1] - ends[1][1])

    checked = 0
    for name, places in (("out", [(0,), (7,), (20,)]), ("bias", [(0,), (6,), (19,)])):
        for place in places:
            moved = float(getattr(before, name)[place] - getattr(after, name)[place])
            gradient = moved * 0.1 ** 0.5 / (toxicity.RATE ** 2 - moved ** 2) ** 0.5  # undoes the first Adagrad step
            assert abs(gradient - slope(getattr(before, name), place)) < 2e-3 + 0.02 * abs(gradient)
            checked += abs(gradient) > 1e-4
    for w, place in ((0, (0, 0, 0)), (1, (1, 4, 0)), (2, (2, 8, 0))):
        moved = float(before.filters[w][place] - after.filters[w][place])
        gradient = moved * 0.1 ** 0.5 / (toxicity.RATE ** 2 - moved ** 2) ** 0.5
        assert abs(gradient - slope(before.filters[w], place)) < 2e-3 + 0.02 * abs(gradient)
        checked += abs(gradient) > 1e-4
    assert checked >= 3


def test_label_never_enters_a_score(spark):
    """Labels of held-out rows change nothing."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (plain(toxicity.score_toxicity(docs, toxicity.fit(docs, x))) for x in (labels, flipped))
    assert a == b


def test_the_fit_costs_the_driver_no_training(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("training on the driver")

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "train", fail)
    net = toxicity.fit(docs, labels)
    assert net.out.any() and net.by_language.any()
