import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from joingrove.llm import pii, queries
from tests.llm.conftest import plain

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
            "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    found = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def base(spans):
    return [s for s in spans if s[0] in PATTERNS]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    sets = ["ab@.", "0123456789", "1.2. -", "+1 ()-0", "a1.@+-", "é 4", "255.", "4-"]
    for _ in range(60_000):
        text = "".join(rng.choice(rng.choice(sets)) for _ in range(rng.randrange(45)))
        assert base(pii.find_spans(text)) == brute(text), text


LONG_RUNS = [lambda n, u=u: u * n for u in ("1", "1.", "a@", "+1", "1 ", "1-", "a.", "+1(")] + [
    lambda n: "+1" + "(" * n, lambda n: "a" * n + "@", lambda n: "a" * n + "@b" + ".c" * n]


def test_long_runs():
    for run in LONG_RUNS:
        assert base(pii.find_spans(run(600))) == brute(run(600))


def test_long_runs_take_time_in_proportion():
    start = time.process_time()
    for run in LONG_RUNS:
        pii.find_spans(run(100_000))
    assert time.process_time() - start < 30


def test_kinds_beyond_the_base():
    text = ('IBAN: DE89 3704 0044 0532 0130 00 paid. account no. 1234 5678 90; https://ann:pw1@host.example/x '
            'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password: short tokens = abcdefgh')
    got = {k: text[s:e] for k, s, e in pii.find_spans(text) if k not in PATTERNS}
    assert got == {"account": "1234 5678 90", "login": "https://ann:pw1@host.example", "secret": "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"} | got
    assert any(text[s:e] == "DE89 3704 0044 0532 0130 00" for k, s, e in pii.find_spans(text) if k == "account")
    assert base(pii.find_spans(text)) == brute(text)


def test_redacted():
    assert pii.redact("x a.b@c.de, 10.1.2.3!") == "x [EMAIL], [IP]!"
    assert pii.redact("plain") == "plain" and pii.redact("") == "" and pii.redact(None) is None
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("ab@.1+ 0") for _ in range(40))
        assert not [s for s in base(pii.find_spans(pii.redact(text))) if s[0] in ("email", "phone") and "[" not in pii.redact(text)[s[1]:s[2]]
                    and pii.redact(text)[s[1]:s[2]] in text and not base(pii.find_spans(text))]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = plain(pii.spans(odd_docs))
    assert len(rows) == odd_docs.count() and all(r["spans"] == "" for r in rows)
    assert pii.spans(no_docs).count() == 0
    hidden = odd_docs.withColumn("text", pii.redacted(F.col("text"), spark))
    assert plain(hidden) == plain(odd_docs)
