import hashlib
import random

import numpy as np

from joingrove.llm import editprint as E


def walked(text):
    """One text, one step at a time."""
    move, note = E._shared()
    chars, out, p = E.classes(text), [0] * E.SLOTS, 0
    if not len(chars):
        return bytes(out)
    steps = E.sampled_steps(len(text))
    for j in range(max(steps) + 1):
        x = int(chars[p]) if p < len(chars) else 0
        for s, at in enumerate(steps):
            if at == j:
                out[s] = int(note[E._mix(j)][x])
        p += int(move[E._mix(j)][x])
    return bytes(out)


def test_side_by_side_equals_one_by_one():
    rng = random.Random(2)
    texts = ["", "a", "ab", "é𝔘", "x" * 3000] + ["".join(rng.choice("abcdé 𝔘\n") for _ in range(rng.randrange(900))) for _ in range(30)]
    assert [r.tobytes() for r in E.prints([E.classes(t) for t in texts])] == [walked(t) for t in texts]


def test_steps_are_shared_between_like_lengths():
    a, b, c = E.sampled_steps(1000), E.sampled_steps(1010), E.sampled_steps(500)
    same = lambda x, y: sum(i == j for i, j in zip(x, y)) / E.SLOTS
    assert same(a, b) > 0.95 and 0.3 < same(a, c) < 0.7
    for n in (1, 77, 1500):
        for slot, at in enumerate(E.sampled_steps(n)[:5]):
            assert at < 2 * n and at in E._records(slot, 14)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = E.edited(text, following)
        p = [np.frombuffer(walked(t), np.uint8) for t in (text, changed, following)]
        out[doc_id] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), p[0].tobytes().hex(), p[1].tobytes().hex(),
                       float((p[0] == p[1]).mean()), float((p[0] == p[2]).mean()))
    return out


def found(df):
    return {r["doc_id"]: tuple(r)[1:7] for r in df.collect()}


def test_next_documents_over_many_partitions(spark):
    rng = random.Random(9)
    rows = [(i * 7 % 101, "".join(rng.choice("abc é") for _ in range(rng.randrange(60))) or None) for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert found(E.fingerprint_pairs(docs)) == brute(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edited_text_rule():
    assert E.edited("abcdefg", "xyz") == "abcdexy" and E.edited("abcdef", "x") == "abcdx" and E.edited("ab", "xyz") == "ab"
    assert E.edited("", "xyz") == ""


def test_edited_texts_are_nearer_than_others(spark):
    got = E.fingerprint_pairs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    nearer = [r["near_edited"] > r["near_next"] for r in got if r["n_chars"] > 100]
    assert sum(nearer) > 0.99 * len(nearer)
    assert len(got) == 1000 and all(0 <= r["near_next"] <= 1 for r in got)


def test_odd_rows(odd_docs, no_docs, spark):
    rows = E.fingerprint_pairs(odd_docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd_docs.collect())
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 5)}) == 1  # equal texts
    assert E.fingerprint_pairs(no_docs).count() == 0
    alone = E.fingerprint_pairs(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_verified_edit_distances():
    rng = random.Random(4)
    for _ in range(600):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        share = rng.choice([0.05, 0.2, 0.5, 0.8])
        assert E.near_by_edits(a, b, share) == (distance(a, b) <= int(share * max(len(a), len(b))))


def edit(rng, text, share):
    out = list(text)
    for _ in range(int(share * len(text))):
        k, change = rng.randrange(len(out)), rng.random()
        out[k:k + 1] = [rng.choice("xyz")] if change < 0.34 else [rng.choice("xyz"), out[k]] if change < 0.67 else []
    return "".join(out)


def test_the_query_verifies_pairs_that_share_a_band(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(600))
    rows = [(5, text), (4, text[:0] + text[400:600] + "other"), (3, "tail " * 40), (2, "short"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in E.fingerprint_pairs(docs).collect()}
    assert got[5]["near_by_edits"] and got[5]["near_edited"] == 1.0  # its last third gives way to the same
    assert not got[3]["near_by_edits"]
    by_id = dict(rows)
    for i, r in got.items():
        mine, following = by_id[i] or "", by_id[i - 1 or 5] or ""
        changed = E.edited(mine, following)
        assert r["near_by_edits"] == (r["shared_bands"] > 0 and distance(mine, changed) <= int(0.05 * max(len(mine), len(changed))))


def test_recall_of_near_texts(spark):
    """Pairs with edits up to the limit of 5 %."""
    rng = random.Random(6)
    rows, pairs = [], []
    for n, count in ((1000, 100), (4000, 60)):
        for share in (0.01, 0.03, 0.045, 0.05):
            for _ in range(count // 4):
                text = "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
                pairs.append((len(rows), len(rows) + 1, share))
                rows += [(len(rows), text), (len(rows) + 1, edit(rng, text, share))]
    got = {r["doc_id"]: r["class_id"] for r in E.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = [got[a] == got[b] for a, b, _ in pairs]
    assert sum(hits) / len(hits) >= 0.93 and len(set(got.values())) == len(rows) - sum(hits)
    hardest = [h for h, (_, _, share) in zip(hits, pairs) if share >= 0.045]
    assert sum(hardest) / len(hardest) >= 0.9


def test_links_between_others_of_a_bucket_are_found(spark):
    """Pairs of near texts whose buckets all hold another text that is near to none of them."""
    rng = random.Random(7)
    head = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = []
    for i in range(6):  # alike by nine tenths: they meet, but are too far apart
        text = head + "".join(rng.choice("ijklmnop") for _ in range(100))
        rows += [(2 * i, text), (2 * i + 1, text[:500] + "Q" + text[501:])]
    got = {r["doc_id"]: r["class_id"] for r in E.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(6)) and len(set(got.values())) == 6


def test_near_texts_of_odd_rows(spark, odd_docs, no_docs):
    got = E.near_texts(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert len({r["class_id"] for r in got if r["doc_id"] in (1, 5)}) == 1
    assert E.near_texts(no_docs).count() == 0


def test_near_texts(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(800)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t[:400] + "Z" + t[401:]) for i, t in enumerate(base)] + [(20, base[0]), (21, None)]
    got = {r["doc_id"]: r["class_id"] for r in E.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[20] == got[0]
    assert all(got[i] == got[10 + i] for i in range(6)) and len({got[i] for i in range(6)}) == 6
