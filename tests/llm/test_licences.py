import random
import re

from joingrove.llm import licences
from tests.llm.conftest import plain

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def base_of(text):
    words = WORD.findall(lowered(text))
    found = [(i, label) for phrase, label in licences.BASE for p in [phrase.split()]
             for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), found


def check(rows, texts):
    assert len(rows) == len(texts)
    for doc_id, text in texts.items():
        r, (n, found) = rows[doc_id], base_of(text)
        assert r["n_words"] == n and r["n_base"] == len(found), text
        assert r["first_word"] == min((i for i, _ in found), default=None)
        assert r["last_word"] == max((i for i, _ in found), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_base_places_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["GNU", "General", "public", "license", "apache", "License", "cc", "BY", "mit", "é", "of", "the", "MIT-license",
            "licence", "K", "CC BY", "2", "gnu general public license", "cc by cc by"]
    texts = {i: " ".join(rng.choice(bits) for _ in range(rng.randrange(30))) for i in range(200)}
    texts |= {900: "apache license " * 3000, 901: "x" * 200_000 + " cc by", 902: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    check({r["doc_id"]: r for r in licences.scan(docs).collect()}, texts)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check({r["doc_id"]: r for r in licences.scan(docs).collect()}, {r["doc_id"]: r["text"] for r in docs.collect()})


def test_notices_with_a_word_more_or_less(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    texts = [(1, "Foo. " + notice), (2, notice.replace("person", "person or firm")), (3, "permission is hereby granted to nobody"),
             (4, "of the " * 500 + notice + " of the" * 500)]
    got = {r["doc_id"]: r["labels"] for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "mit", 3: "", 4: "mit"}


def test_stray_matches_on_either_side_take_nothing(spark):
    """2-grams of the notice all over the text neither hide an occurrence nor make one."""
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    longer = notice.replace("person", "person or firm")
    stray = "this software x of this y free of z " * 60
    texts = [(1, f"{longer} {'this software x ' * 60}"), (2, f"{stray} {longer} {stray}"), (3, stray), (4, f"{stray} {notice} {stray}"),
             (5, f"{longer} {longer} {stray} {longer}")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: x for i, (x, _) in got.items()} == {1: "mit", 2: "mit", 3: "", 4: "mit", 5: "mit"}
    assert got[4][1] == 1.0 and got[3][1] == 0.0 and all(0.8 <= got[i][1] < 1 for i in (1, 2, 5))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = licences.templates()
    found = licences.spans(licences.votes(docs, known), known)
    places = sorted((r["doc_id"], r["start"], r["words"]) for r in found.collect() if r["template"] == len(licences.BASE))
    n = len(stray.split())
    starts = [(1, 0), (2, n), (4, n), (5, 0), (5, 18), (5, 36 + n)]
    assert len(places) == len(starts) and all(16 <= w <= 24 for *_, w in places)  # a span may take in strays next to it
    assert all(d == e and abs(a - b) <= 8 for (d, a, _), (e, b) in zip(places, starts))


def test_whole_licence_texts_with_changes(spark):
    rng = random.Random(4)
    texts, want = [], {}
    for n, (text, label) in enumerate(licences.LICENCE_TEXTS):
        words = text.split()
        for k, share in enumerate((0.0, 0.02, 0.04)):
            out = []
            for w in words:  # words left out, put in, and changed
                r = rng.random()
                out += [] if r < share / 3 else [w, "indeed"] if r < share * 2 / 3 else ["other"] if r < share else [w]
            texts.append((10 * n + k, " ".join(["filler"] * 30 + out + ["filler"] * 30)))
            want[10 * n + k] = label
        texts.append((10 * n + 5, " ".join(rng.sample(words, len(words)))))
    got = {r["doc_id"]: r["labels"].split(",") for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, label in want.items())
    assert all(got[10 * n + 5] == [""] for n in range(len(licences.LICENCE_TEXTS)))


def test_odd_rows(odd_docs, no_docs):
    rows = plain(licences.scan(odd_docs))
    assert len(rows) == odd_docs.count() and all(r["n_base"] == 0 for r in rows)
    assert sum(r["n_words"] == 0 for r in rows) == 4
    assert licences.scan(no_docs).count() == 0


def test_repeated_rows_each_get_the_result(spark):
    docs = spark.createDataFrame([(1, "cc by")] * 3 + [(1, "mit license x mit license"), (None, "cc by")], "doc_id long, text string")
    got = sorted((r["n_base"], r["base_labels"]) for r in licences.scan(docs).collect())
    assert got == [(1, "cc-by")] * 4 + [(2, "mit")]
