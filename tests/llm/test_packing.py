import random
from zlib import crc32

import numpy as np
import pytest

from joingrove.llm import packing as K


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for load in sorted(set(bins)):
            if load + items[i] <= capacity:
                rest = list(bins)
                rest.remove(load)
                go(i + 1, [*rest, load + items[i]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def counted(items, capacity):
    counts = [0] * (capacity + 1)
    for x in items:
        counts[x] += 1
    return counts


def test_fixed_sets_are_in_some_best_packing():
    rng = random.Random(3)
    for _ in range(700):
        capacity = rng.choice([8, 12, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randrange(9))]
        rest = counted(items, capacity)
        fixed = K.dominating(rest, capacity)
        assert all(sum(s) <= capacity for s, _ in fixed)
        left = [s for s, n in enumerate(rest) for _ in range(n)]
        assert sum(n for _, n in fixed) + optimum(left, capacity) == optimum(items, capacity), items


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice([10, 64])
        items = [rng.randint(1, capacity) for _ in range(rng.randrange(200))]
        sequences, rank = {}, {}
        table = K.plan(counted(items, capacity), capacity)
        for x in items:
            r = rank[x] = rank.get(x, -1) + 1
            _, first, times, seq, offset = max(e for e in table if e[0] == x and e[1] <= r)
            nth, within = divmod(r - first, times)
            sequences.setdefault(seq + nth, []).append((offset + within * x, x))
        for own in sequences.values():
            at = 0
            for offset, x in sorted(own):
                assert offset == at
                at += x
            assert at <= capacity
        assert len(sequences) <= 1.25 * -(-sum(items) // capacity) + 2


def test_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(0)
    size = lambda n: len(K.plan(np.bincount(np.minimum(2047, rng.lognormal(5.5, 1.2, n).astype(int) + 1), minlength=2049).tolist()))
    assert size(3_000_000) < 2 * size(300_000) < 40_000


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(texts):
    return [[*e.ids, 0] for e in tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_the_tokenizers_library():
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "The", "don't", "'s", "é", "日本", "12", "1.5", "!!", "𝔘", " ", " ", "\x1c", "word", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [" ".join(rng.choice(bits[6:]) for _ in range(30)) for _ in range(500)]
    got = K.encoder(K.tokenizer_path()).batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [i[:-1] for i in ids_of(texts)]


def test_more_stretches_than_are_remembered(monkeypatch):
    monkeypatch.setattr(K, "REMEMBER", 10)
    coder = K.Encoder(K.tokenizer_path())
    texts = [f"word{i} of word{i + 1},\nend" for i in range(50)]
    assert [np.frombuffer(g, "<u4").tolist() for g in coder.batch(texts)] == [i[:-1] for i in ids_of(texts)]


def check(rows, docs, capacity=2048):
    ids = dict(zip(docs, ids_of(docs.values())))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for doc_id, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and (r["length"] == capacity or r["piece"] == 0)
            assert crc32(np.array(ids[doc_id][at:at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[doc_id]) and (len(own) > 1) == (at > capacity)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_given_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = K.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert check(rows, docs) <= -(-sum(r["length"] for r in rows) // 2048) + 1


@pytest.mark.parametrize("ranked", [1, 50, 200_000])
def test_hot_lengths_over_salted_parts(spark, monkeypatch, ranked):
    monkeypatch.setattr(K, "RANKED", ranked)
    docs = {i: "a b" if i % 3 else "word " * (i * 7) for i in range(300)} | {500: None, 501: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    check(K.pack_documents(df).collect(), docs)


def test_odd_rows(odd_docs, no_docs):
    rows = K.pack_documents(odd_docs).collect()
    assert sum(r["piece"] == 0 for r in rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist()
    assert K.pack_documents(no_docs).count() == 0


def test_added_tokens_keep_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "a", "The", "é", "日本", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(500)] + ["<|endoftext|>", "a <|endoftext|> b"]
    want = [e.ids for e in default.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in K.encoder(K.tokenizer_path()).with_added(texts)] == want
    rows = K.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows} == {
        i: (len(ids) + 1, crc32(np.array([*ids, 0], "<u4").tobytes())) for i, ids in enumerate(want)}
