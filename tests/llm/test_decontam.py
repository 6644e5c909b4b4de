import random
import re
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from joingrove.llm import decontam as D
from joingrove.llm import queries
from tests.llm.conftest import plain


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return Counter(" ".join(w[i:i + 5]) for i in range(len(w) - 4))


def fingerprint(counts):
    total, out = sum(counts.values()), 0
    hashed = {s: xxhash.xxh64_intdigest(s.encode(), 42) for s in counts}
    for b in range(64):
        if 2 * sum(n for s, n in counts.items() if hashed[s] >> b & 1) > total:
            out |= 1 << b
    return out


def similarity(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def brute(docs, items):
    """Every window of every document against every item: {(doc, item): best similarity}."""
    out = {}
    known = {i: (len(words(t)), shingles(words(t))) for i, t in items.items() if len(words(t)) >= 5}
    for d, text in docs.items():
        w = words(text)
        for i, (n, s) in known.items():
            for start in range(max(len(w) - n, 0) + 1):
                own = shingles(w[start:start + n])
                if own and similarity(own, s) >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), similarity(own, s))
    return out


def found(df):
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in df.collect()}


def frame(spark, rows, name="doc_id"):
    return spark.createDataFrame(list(rows.items()), f"{name} long, text string")


def corpus():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["ba", "do", "ki", "lu", "me", "no", "ra", "so", "ti", "vé"]) + str(rng.randrange(60)) for _ in range(n))
    items = {i: text(rng.randrange(12, 60)) for i in range(25)} | {90: "four words are few", 91: None, 92: "same shingle " * 12}
    docs = {i: text(rng.randrange(0, 90)) for i in range(40)}
    for k in range(60):
        w = items[k % 25].split()
        for _ in range(k % 4):  # an edit or a few at either end
            w = w[1:] if rng.random() < 0.3 else w[:-1] if rng.random() < 0.5 else w[:-1] + [text(1)]
        docs[100 + k] = f"{text(rng.randrange(20))} {'  '.join(w).upper()}. {text(rng.randrange(20))}"
    w = items[3].split()
    docs[200] = " ".join(w[:len(w) // 2]) + " inserted " + " ".join(w[len(w) // 2:])
    docs[201] = items[92] + " " + items[92]
    docs[202] = " ".join(items[i] for i in range(20))
    docs[203] = items[5]
    items[93] = text(59)
    w = items[93].split()
    docs[204] = " ".join([text(20), *w[30:], *w[:30], text(20)])  # no shingle stands where a window would have it
    return docs, items


def test_equals_all_windows_against_all_items(spark):
    docs, items = corpus()
    rows = D.leaks(frame(spark, docs).repartition(5), frame(spark, items, "item_id")).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want.keys() and len(rows) == len(want) > 60
    assert {r["by_blocks"] for r in rows} == {True, False}
    for r in rows:  # the window is similar as stated, and the best one where no block found it
        own = shingles(words(docs[r["doc_id"]])[r["start_word"]:r["start_word"] + r["n_words"]])
        item = shingles(words(items[r["item_id"]]))
        assert abs(r["similarity"] - similarity(own, item)) < 1e-9 and 0.8 <= r["similarity"] <= want[r["doc_id"], r["item_id"]] + 1e-9
        assert r["by_blocks"] <= (r["distance"] <= D.RADIUS)
        assert r["by_blocks"] or abs(r["similarity"] - want[r["doc_id"], r["item_id"]]) < 1e-9


def test_the_second_search_ends_where_nothing_is_left(spark, monkeypatch):
    """Blocks find the copies; an item's rare shingle alone opens the second search, which finds no window in `open_` and is not planned further."""
    rng, steps, plain_stage = random.Random(5), [], D.stage_observed
    monkeypatch.setattr(D, "stage_observed", lambda df, label, *m: steps.append(label) or plain_stage(df, label, *m))
    text = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    items = {i: text(30) for i in range(4)}
    docs = {10 + i: f"{text(9)} {items[i]} {text(9)}" for i in range(4)} | {20: text(50)}
    open_ = docs | {30 + k: f"{text(9)} {' '.join(items[0].split()[k:k + 6])} {text(40)}" for k in range(25)}
    for given in (docs, open_):
        steps.clear()
        assert found(D.leaks(frame(spark, given), frame(spark, items, "item_id"))).keys() == {(10 + i, i) for i in range(4)} == brute(given, items).keys()
        assert ("leak-best" in steps) == (given is open_)
        assert "leak-cells" in steps and "leak-other-windows" not in steps


def test_places_of_rare_shingles_are_written_together_and_once(spark, monkeypatch):
    """Not a file for each task that read documents, and not again for each row repeated in id and text."""
    rng, steps, plain_stage = random.Random(6), {}, D.stage
    monkeypatch.setattr(D, "stage", lambda df, label: steps.setdefault(label, plain_stage(df, label)))
    text = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    items = {i: text(30) for i in range(4)}
    docs = {10 + i: f"{text(9)} {items[i]} {text(9)}" for i in range(4)}
    rows = [*docs.items()] * 30 + [(None, docs[10])] * 30
    repeated = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    assert found(D.leaks(repeated, frame(spark, items, "item_id"))) == {(10 + i, i): 1.0 for i in range(4)} | {(None, 0): 1.0}
    hits = steps["leak-hits"]
    assert hits.count() == hits.distinct().count() > 0 and hits.groupBy("d").count().count() == 5
    assert len(hits.inputFiles()) < 12


def test_without_broadcasts(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(D, "KEYS", 0)
    assert found(D.leaks(frame(spark, docs), frame(spark, items, "item_id"))).keys() == brute(docs, items).keys()


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [rng.getrandbits(64) for _ in range(30)]
    windows = []
    for x in items:
        for d in (0, 3, 12, 14, 15, 16, 17):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            windows.append(y)
    a = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(windows)], "wid long, fp long")
    b = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(items)], "item long, fp long")
    got = {tuple(r) for r in D.within_radius(a, b).collect()}
    assert got == {(i, j, (x ^ y).bit_count()) for i, x in enumerate(windows) for j, y in enumerate(items) if (x ^ y).bit_count() <= D.RADIUS}


def test_fingerprints_equal_the_definition(spark):
    rows = {i: " ".join(random.Random(i).choice("abcdefg") for _ in range(5 + i)) for i in range(30)}
    counted = D._counted(frame(spark, rows, "wid").select("wid", D.words(F.col("text")).alias("w")), "wid")
    got = {r["wid"]: r["fp"] % (1 << 64) for r in D._fingerprints(counted, "wid").collect()}
    assert got == {i: fingerprint(shingles(words(t))) for i, t in rows.items()}


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    near = {d: t for d, t in docs.items() if any(s in shingles(words(t)) for x in items.values() for s in shingles(words(x)))}
    got = found(queries.op10_decontaminate(spark, sf))
    assert got.keys() == brute(near, items).keys()
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} <= got.keys()


def test_no_python_on_the_executors(spark):
    plans = []
    real = spark.read.parquet(f"/root/testdata/sf0.001/documents.parquet")
    for df in (D.leaks(real, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")),):
        plans.append(df._jdf.queryExecution().toString())
    assert not any(re.search("Python|Arrow|Pandas", p) for p in plans)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a b c d e f g", 0, "x"), (None, "a b c d e f g", 1, "x"), (2, None, 2, "x"), (3, "", 3, None), (1, "a b c d e f g", 4, "x")],
                                  "item_id long, text string, w int, shingle string")
    got = plain(D.leaks(odd_docs, items))
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (5, 1)} and len(got) == 2
    kept = D.without_leaks(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert D.leaks(no_docs, items).count() == 0 and D.leaks(odd_docs, items.limit(0)).count() == 0
    assert D.without_leaks(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_swapped_halves_are_found(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = {n: text(n) for n in (40, 50, 59, 90)}
    docs = {}
    for n, t in items.items():
        w = t.split()
        docs[n] = f"{text(100)} {' '.join(w[n // 2:] + w[:n // 2])} {text(100)}"
    got = found(D.leaks(frame(spark, docs), frame(spark, items, "item_id")))
    assert {k: round(v, 9) for k, v in got.items()} == {(n, n): round((n - 8) / n, 9) for n in items}
    assert got.keys() == brute(docs, items).keys()


def test_short_unspaced_and_huge_items(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    huge = text(70_000)
    items = {1: "three Short words", 2: "床前明月光疑是地上霜", 3: "สวัสดีชาวโลกทั้งหมด", 4: huge, 5: "?!", 6: "unique", 7: "漢字"}
    docs = {1: f"{text(9)} three, short WORDS {text(9)}", 2: "昔人云床前明月光疑是地上霜舉頭望", 3: "ก่อนสวัสดีชาวโลกทั้งหมดแล้ว", 4: f"{text(50)} {huge} {text(50)}",
            5: "short three words", 6: "Unique", 7: "一漢字二", 8: "字漢", 9: "three short", 10: "光月明前床霜上地是疑"}
    got = found(D.leaks(frame(spark, docs), frame(spark, items, "item_id")))
    assert got == {(i, i): 1.0 for i in (1, 2, 3, 4, 6, 7)}


def test_a_document_that_holds_the_whole_benchmark(spark):
    """Items with a common beginning and end: rows follow the document's length, not its square."""
    rng = random.Random(12)
    items = {i: "question what is the right answer to this " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) + " answer the following is right"
             for i in range(2000)}
    docs = {1: " ".join(items[i] for i in range(1000)), 2: " ".join(items.values()),
            3: " ".join(f"{t[:-60]} {t[:200]}" for t in items.values())}
    start = time.time()
    got = D.leaks(frame(spark, docs), frame(spark, items, "item_id")).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in got if r[0] < 3} == {1: 1000, 2: 2000}
    assert time.time() - start < 120


def test_fingerprint_of_more_shingles_than_sixteen_bits_count(spark):
    rng = random.Random(10)
    counts = Counter({f"s{i}": rng.choice([1, 30_000, 2**20]) for i in range(300)})
    rows = spark.createDataFrame([(1, s, n) for s, n in counts.items()], "wid long, shingle string, n long")
    assert D._fingerprints(rows, "wid").first()["fp"] % (1 << 64) == fingerprint(counts)


def test_no_pair_is_lost_to_a_radius(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items, docs, far = {i: text(49) for i in range(400)}, {}, 0
    for i, t in items.items():  # one word of 49 replaced: 40 of 50 shingles are shared
        w = t.split()
        w[rng.randrange(10, 39)] = "other"
        docs[i] = f"{text(5)} {' '.join(w)} {text(5)}"
        far += (fingerprint(shingles(w)) ^ fingerprint(shingles(t.split()))).bit_count() > 15
    got = found(D.leaks(frame(spark, docs), frame(spark, items, "item_id")))
    assert got == {(i, i): 0.8 for i in items} and far > 0
