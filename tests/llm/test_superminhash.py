import random
import re

import numpy as np
import pytest

from joingrove.llm import superminhash as smh
from tests.llm.conftest import plain
from tests.llm.test_simhash import reach


def slow_set(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(map(tuple, [words] if words else []))


def slow_groups(rows):
    """rows: (doc_id, text); rows in the order given."""
    sets = [slow_set(t) for _, t in rows]
    groups = reach(sorted(set(sets), key=sorted), lambda a, b: False)
    distinct = sorted({s for s in sets if s}, key=sorted)
    number = {s: i for i, s in enumerate(distinct)}
    groups = reach(list(range(len(distinct))), lambda i, j: 100 * len(distinct[i] & distinct[j]) >= 80 * len(distinct[i] | distinct[j]))
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[groups[number[s]]] = min(least.get(groups[number[s]], i), i)
    out = []
    for (i, _), s in zip(rows, sets):
        c = least.get(groups[number[s]]) if s else i
        out.append({"doc_id": i, "n_shingles": len(s), "component_id": c, "kept": i == c})
    return sorted(out, key=lambda d: repr(sorted(d.items())))


def slow_signature(elements):
    """The published algorithm, an element after the other, with the same draws."""
    m, mask = smh.PLACES, (1 << 64) - 1

    def draw(h, step):
        x = (h + (step + 1) * 0x9E3779B97F4A7C15) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    values = [(m, 0)] * m
    for h in elements:
        order = list(range(m))
        for step in range(m):
            u = draw(h, step)
            at = step + ((u >> 40) * (m - step) >> 24)
            order[step], order[at] = order[at], order[step]
            values[order[step]] = min(values[order[step]], (step, u & 0xFFFFFFFF))
    return values


@pytest.mark.parametrize("n", [1, 2, 5, 40, 300, 3000])
def test_signatures_equal_the_plain_algorithm(n):
    rng = random.Random(n)
    sets = [np.array([rng.getrandbits(64) for _ in range(n)], np.uint64), np.array([rng.getrandbits(64) for _ in range(7)], np.uint64)]
    got = smh.signatures(sets)
    for row, s in zip(got, sets):
        want = [smh._mixed(np.array([(step << 32) + r], np.uint64))[0] >> np.uint64(48) for step, r in slow_signature([int(h) for h in s])]
        assert [int(x) for x in row] == [int(x) for x in want]


def test_estimates_vary_less_than_by_independent_ranks():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(400):
        common, a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (20, 20, 20))
        p, q = smh.signatures([np.concatenate([common, a]), np.concatenate([common, b])])
        errors.append((p == q).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.008
    assert np.std(errors) < 0.9 * np.sqrt(1 / 3 * 2 / 3 / smh.PLACES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")


def edited(rng, words, share):
    return [rng.choice(["x", "y", "z"]) + str(rng.randrange(1000)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("small,block", [(smh.SMALL, smh.BLOCK), (1, smh.BLOCK), (2, 5), (10 ** 9, 1)])
def test_groups_equal_brute_force(spark, monkeypatch, small, block):
    """Chains, hubs whose copies are not linked with one another, common passages, copies and short texts."""
    monkeypatch.setattr(smh, "BLOCK", block)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([12, 30, 80, 200]))]
        rows += [base] + [edited(rng, base, s) for s in (0.0, 0.02, 0.03, 0.05, 0.05, 0.08, 0.1)]
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, 0.04)
            rows.append(chain)
    hub = [rng.choice(words) for _ in range(20)]
    rows += [hub] + [hub[:k] + [f"q{k}"] + hub[k + 1:] for k in range(1, 19)]  # each is linked with the hub alone
    passage = [rng.choice(words) for _ in range(60)]
    rows += [passage + [rng.choice(words) for _ in range(rng.choice([10, 20, 40]))] for _ in range(60)]
    rows += [["one"], ["ONE"], ["one", "two"], ["two", "one"], ["one", "two", "one"], [], []]
    docs = [(i * 7 % 1009, " \t".join(w)) for i, w in enumerate(rows)]
    docs += docs[:20] + [(None, docs[3][1]), (None, "only here, without an id"), (5000, None)]
    got = plain(smh.near_duplicates(frame(spark, docs), small=small))
    assert got == slow_groups(docs)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 exactly: 80 of 100 shingles in common."""
    rows = []
    for p in range(500):
        own = [f"a{p}x{i}" for i in range(91)]
        rows += [(2 * p, " ".join(own)), (2 * p + 1, " ".join(own[:81] + [f"b{p}x{i}" for i in range(10)]))]
    got = {r["doc_id"]: r["component_id"] for r in smh.near_duplicates(frame(spark, rows)).collect()}
    assert sum(got[2 * p + 1] == 2 * p for p in range(500)) == 500


def test_a_hot_bucket_costs_no_pairs(spark):
    """Thousands of near copies of one text and a third group near the limit: rows grow with the members, not with their square."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.01))) for i in range(3000)]
    rows += [(5000 + i, " ".join(edited(rng, base, 0.5))) for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in smh.near_duplicates(frame(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(3000))
    assert all(got[5000 + i] == 5000 + i for i in range(30))


def test_members_of_a_hot_bucket_are_looked_up_twice_at_most(spark, monkeypatch):
    """Once for the pivot and once for the blocks; between these only those that the pivot has not linked."""
    rng, looked_up, plain_join = random.Random(4), [], smh.join_copies

    def counted(rows, lookup, key, counts, total):
        out = plain_join(rows, lookup, key, counts, total)
        if key == "bucket":
            looked_up.append(out.count())
        return out

    monkeypatch.setattr(smh, "join_copies", counted)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.01))) for i in range(300)]
    rows += [(1000 + i, " ".join(edited(rng, base, 0.2))) for i in range(10)]
    got = plain(smh.near_duplicates(frame(spark, rows)))
    assert got == slow_groups(rows)
    assert len(looked_up) > 2 and sum(looked_up) < 2.2 * looked_up[0]


def test_members_of_many_hot_buckets_meet_their_sets_once(spark, monkeypatch):
    """A node stands in up to two buckets a band, but its signature and set are joined to it once."""
    rng, joined, frames, plain_join = random.Random(4), [], type(spark.range(1)), type(spark.range(1)).join
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.01))) for i in range(300)]
    rows += [(1000 + i, " ".join(edited(rng, base, 0.2))) for i in range(10)]
    large = smh._large_buckets

    def watched(members, nodes, sets, parts):
        def counted(self, other, on=None, how=None):
            out = plain_join(self, other, on, how)
            joined.append(out.count())
            return out

        with monkeypatch.context() as m:
            m.setattr(frames, "join", counted)
            out = large(members, nodes, sets, parts)
        joined.append(members.select("node").distinct().count())
        assert members.count() > 5 * joined[-1]
        return out

    monkeypatch.setattr(smh, "_large_buckets", watched)
    assert plain(smh.near_duplicates(frame(spark, rows))) == slow_groups(rows)
    assert len(joined) == 3 and set(joined) == {joined[-1]}


def test_given_documents(spark):
    from joingrove.llm.queries import op11_superminhash
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert plain(op11_superminhash(spark, "/root/testdata/sf0.001")) == slow_groups(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    odd = odd_docs.selectExpr("*", "1 AS node", "2 AS bucket", "3 AS n")
    assert plain(smh.near_duplicates(odd)) == slow_groups(rows)
    assert smh.near_duplicates(no_docs).count() == 0
