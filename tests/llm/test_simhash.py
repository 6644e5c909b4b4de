import random

import pytest
import xxhash

from joingrove.llm import queries, simhash
from joingrove.llm.components import components
from tests.llm.conftest import plain


def slow_fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def brute(docs):
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    groups = reach(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, fp in fps.items():
        least[groups[fp]] = min(least.get(groups[fp], i), i)
    return {i: (f"{fp:016x}", least[groups[fp]]) for i, fp in fps.items()}


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    words = ["A", "b", "É", "\x1f", " ", "ß", "x,", "\n", "\t", "\v", "  "]
    for t in ["", " \n", None, "one", "one TWO", "a b c", "a b c d"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)]:
        assert simhash.fingerprint(t) % (1 << 64) == slow_fingerprint(t), repr(t)


@pytest.mark.parametrize("limit", [0, 1, 3, 10 ** 9])
def test_links_join_what_all_pairs_join(spark, limit):
    """Clusters of fingerprints a few bits apart, with long lists split at each level."""
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        own = [centre]
        for _ in range(14):
            near = rng.choice(own)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                near ^= 1 << b
            own.append(near)
        fps |= set(own)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = [tuple(r) for r in simhash.links(df, limit).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 3 for a, b in links)
    want = reach(sorted(map(signed, fps)), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 3)
    own = set(links) | {(b, a) for a, b in links}
    assert reach(sorted(want), lambda a, b: (a, b) in own) == want


def test_every_pair_within_the_radius_meets_in_a_list():
    for bits in __import__("itertools").combinations(range(8), 3):
        assert any(not set(t) & set(bits) for t in simhash.TRIPLES)


def test_the_tally_drops_pairs_and_loses_none(spark):
    rng = random.Random(13)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:  # within reach; and alike in three or four bytes only
        fps.add(x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
        y = x
        for p in rng.sample(range(8), rng.choice([4, 5])):
            y ^= rng.randrange(1, 256) << (8 * p)
        fps.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    postings = simhash._postings(df, simhash.TRIPLES)
    meet = {(r["a"], r["b"]) for r in postings.alias("x").join(postings.withColumnRenamed("fp", "b"), ["list", "key"])
            .selectExpr("fp AS a", "b").where("a < b").collect()}
    kept = {(r["a"], r["b"]): r["shared"] for r in simhash.tallied(postings).collect()}
    near = {(a, b) for a in map(signed, fps) for b in map(signed, fps) if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    same = lambda a, b: sum((a >> 8 * p & 255) == (b >> 8 * p & 255) for p in range(8))
    assert near <= kept.keys() < meet and all(n == same(a, b) >= 5 for (a, b), n in kept.items())
    assert len(meet - kept.keys()) >= 10


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash_near_dedup(spark, sf).collect()}
    assert got == brute(docs)


def test_hot_copies(spark):
    docs = {i: "the same text for a third of all" if i % 3 == 0 else f"text number {i} of {i * 7} and {i * 13}" for i in range(600)}
    docs |= {1000: "", 1001: None, 1002: " "}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == brute(docs)


def test_one_of_each(spark, odd_docs, no_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = sorted((r["text"] or "").strip() for r in kept.collect())
    assert texts == sorted({(r["text"] or "").strip() for r in odd_docs.collect()})
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 4, 6, 8]
    assert simhash.one_of_each(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0


def test_odd_rows(odd_docs):
    rows = plain(simhash.near_duplicates(odd_docs))
    assert len(rows) == odd_docs.count()
    empty = {r["component_id"] for r in rows if r["fp"] == 0}
    assert empty == {2}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 7), (None, 3), (3, None)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    own = set(real) | {(b, a) for a, b in real}
    assert got == reach(sorted({x for p in real for x in p}), lambda a, b: (a, b) in own)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_links_or_hot_keys_little_is_planned(spark, monkeypatch):
    """No rounds of components, no groups and no broadcast of hot keys where there is nothing of the kind."""
    from joingrove.llm import common
    from joingrove.sources import staging

    labels, path = [], staging.fresh_path
    monkeypatch.setattr(staging, "fresh_path", lambda session, label: labels.append(label) or path(session, label))
    rng = random.Random(8)
    docs = {i: " ".join(f"w{rng.randrange(9999)}" for _ in range(30)) for i in range(40)}
    docs |= {100 + i: docs[i] for i in range(10)}
    found = simhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in found.collect()} == brute(docs)
    assert labels.count("components") == 1 and "simhash-groups" not in labels and "simhash-named" not in labels
    rows, lookup = spark.createDataFrame([(i % 7, i) for i in range(500)], "k long, v long"), spark.createDataFrame([(i, 72, -i) for i in range(7)], "k long, n long, w long")
    for join in (common.join_hot(rows, lookup, "k", "n", 500, 72), common.join_copies(rows, lookup.drop("n"), "k", lookup.select("k", "n"), 500, 72)):
        assert sorted(map(tuple, join.select("k", "v", "w").collect())) == sorted((i % 7, i, -(i % 7)) for i in range(500))
        assert join._jdf.queryExecution().analyzed().toString().count("Join") == 1
