import base64
import glob
import hashlib
import random

import pytest
import zstandard

from joingrove.llm import queries, warc
from tests.llm.conftest import plain


def brute(rows, min_bytes=0):
    lead = {}
    for page_id, _, html in rows:
        if page_id is not None:
            lead[html or ""] = max(lead.get(html or "", page_id), page_id)
    out = []
    for page_id, url, html in rows:
        body = (html or "").encode()
        first = lead.get(html or "") if len(body) >= min_bytes else page_id
        revisit = first is not None and page_id != first
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def digest(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_round_trip(spark, min_bytes):
    rng = random.Random(3)
    rows = [(i, f"http://x.example/é {i}\r\nA: b", rng.choice(["", None, "aa", "the same", f"é𝔘 {i}", "\r\n\r\nWARC/1.1\r\n", "x" * 50_000]))
            for i in range(300)]
    got = warc.round_trip(pages(spark, rows).repartition(5), min_bytes=min_bytes)
    assert digest(got) == brute(rows, min_bytes)


def test_payloads_come_back(spark):
    rows = [(i, None, f"payload {i} é" * (i % 50)) for i in range(120)]
    got = warc.round_trip(pages(spark, rows), payload=True)
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in got.where("record_type = 'response'").collect()}
    assert all(back[i] == h for i, _, h in rows if i in back) and len(back) == len({h for _, _, h in rows})


def test_archives_roll_and_hold_their_dictionary(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choices("abcdefgh ", k=3000))) for i in range(200)]
    manifest = warc.write_archives(warc.plan_records(pages(spark, rows).repartition(2)), str(tmp_path / "w"), roll_bytes=60_000).collect()
    files = glob.glob(str(tmp_path / "w" / "*.warc.zst"))
    assert len(files) == len(manifest) > 4 and sum(r["records"] for r in manifest) == 200
    assert not glob.glob(str(tmp_path / "w" / "*.draft"))
    for f in files:
        with open(f, "rb") as data:
            raw = data.read()
        assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE
        packed = raw[8:8 + int.from_bytes(raw[4:8], "little")]
        assert len(zstandard.ZstdDecompressor().decompress(packed)) > 0
    assert digest(warc.read_archives(spark, str(tmp_path / "w"))) == brute(rows)


def _archive(records, dictionary=b""):
    packed = zstandard.ZstdCompressor().compress(dictionary)
    frames = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + b"".join(map(frames.compress, records))


def test_frames_without_or_with_plain_dictionary():
    records = [warc._record(i, "u", b"body" * i, False, None) for i in range(5)]
    assert list(warc._frames(_archive(records), "a")) == records
    assert list(warc._frames(_archive(records, b"body" * 100), "a")) == records
    assert list(warc._frames(b"".join(map(zstandard.ZstdCompressor().compress, records)), "a")) == records
    assert list(warc._frames(_archive([]), "a")) == []
    raw = b"plain dictionary, not compressed " * 4
    unpacked = warc.SKIPPABLE.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert list(warc._frames(unpacked + coder.compress(records[1]), "a")) == [records[1]]


def test_wrong_archives_are_refused():
    good = warc._record(1, "u", b"hello", False, None)
    data = _archive([good])
    for bad in (data[:-3], data[:6] + b"\xff\xff" + data[8:], data[:-10] + bytes(10)):
        with pytest.raises((warc.ArchiveError, zstandard.ZstdError)):
            list(warc._frames(bad, "a"))
    for bad in (good.replace(b"hello", b"hullo"), good[:-1], good.replace(b"WARC/1.1", b"WORC/1.1"), good + b"x",
                good.replace(b"Content-Length: 5", b"Content-Length: 6"), good.replace(b"WARC-Type: response", b"WARC-Type: other"),
                good.replace(b"WARC-Payload-Digest", b"X-Digest")):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "u", "x"), (1, "u", "x"), (1, "u", "x"), (2, None, "y"), (2, "v", "z"), (3, "", "")]
    df = spark.createDataFrame([(*r, "e", b"b", 1) for r in rows], "page_id long, url string, html string, digest string, body binary, lead int")
    assert digest(warc.round_trip(df)) == brute(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_hot_payload(spark):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"{i}") for i in range(900)]
    assert digest(warc.round_trip(pages(spark, rows).repartition(8))) == brute(rows)


def test_query_equals_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = queries.op9_warc(spark, sf)
    want = db.execute(queries.oracle_sql()["op9_warc"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(want.fetchall(), key=repr) == sorted(map(tuple, got.select(*names).collect()), key=repr)
    assert plain(got.where("record_type = 'revisit' and refers_to is null")) == []
