"""WARC archives compressed with Zstandard: one frame a record, behind a dictionary in a skippable frame.

Writing decides per payload which page carries it (`plan_records`), then every task rolls archive
files of bounded size into a folder that all executors share. Reading takes whole archives from any
store by Spark's binaryFile source, loads the dictionary from the leading skippable frame, decodes
frame by frame and checks headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joingrove.llm.common import join_hot, map_batches, stage
from joingrove.sources.staging import fresh_path

SKIPPABLE = 0x184D2A5D  # the magic number that .warc.zst gives to a dictionary frame
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
SUFFIX = ".warc.zst"
#: An archive is closed once it has this many compressed bytes; one record may go beyond it.
ROLL_BYTES = 16 << 20
#: Records and bytes of a task's first pages that its dictionary is trained on, and the dictionary's size.
DICT_RECORDS, DICT_SAMPLE_BYTES, DICT_BYTES = 256, 1 << 20, 16 << 10

RECORD_COLUMNS = ("page_id long, uri string, record_type string, refers_to long, payload_bytes long, "
                  "payload_digest string, archive string")


class ArchiveError(ValueError):
    """An archive or a record in it is not well formed."""


# ---------------------------------------------------------------- which record carries a payload

def plan_records(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html",
                 min_bytes: int = 0) -> DataFrame:
    """page_id, uri, body, revisit (boolean) and refers_to for every row of `pages`.

    Among rows with equal payloads of at least `min_bytes` bytes the one with the largest page_id is
    the response, the others revisit it. A null body is an empty payload; a null page_id is smaller
    than any other; rows repeated with the id of the response are responses themselves.
    Only identifiers and digests are grouped; the payloads move once, by page_id.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"),
                        body.alias("body"))
    rows = rows.withColumn("digest", F.sha1("body"))
    light, seen = stage_rows(rows.where(F.octet_length("body") >= min_bytes)
                             .select(F.col("page_id"), "digest"), "warc-digests")
    shared = (light.groupBy("digest").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n_rows"))
              .where("n_rows > 1 and lead is not null"))
    revisits = (join_hot(light, stage(shared, "warc-shared"), "digest", "n_rows", seen)
                .where("page_id is null or page_id < lead").distinct()
                .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "lead"))
    same = rows.page_id.eqNullSafe(revisits.r_id) & (rows.digest == revisits.r_digest)
    return (rows.join(revisits, same, "left")
            .select("page_id", "uri", "body", F.col("lead").isNotNull().alias("revisit"),
                    F.col("lead").alias("refers_to")))


def stage_rows(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The written frame and its number of rows, counted on the way."""
    from joingrove.sources.staging import stage_observed
    out, seen = stage_observed(df, label, F.count(F.lit(1)).alias("n"))
    return out, int(seen["n"] or 0)


# ---------------------------------------------------------------- records

def _record(page_id, uri, body: bytes, revisit: bool, refers_to) -> bytes:
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n").encode()
    block = http if revisit else http + body
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {quote(uri, safe='%/:?#[]@!$&()*+,;=~-._' + chr(39))}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ArchiveError(f"record id {urn!r}")
    return None if urn[10:-1] == "none" else int(urn[10:-1])


def _headers(raw: bytes, first: bytes) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    if not lines[0].startswith(first):
        raise ArchiveError(f"a header block starts with {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"header line {line[:40]!r}")
        out[name.strip().lower().decode("ascii")] = value.strip().decode("utf-8")
    return out


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one decoded record; raises ArchiveError where headers and content disagree."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError("no end of the record's headers")
    h = _headers(head, b"WARC/1.")
    missing = {"warc-type", "warc-record-id", "content-length", "warc-payload-digest"} - h.keys()
    if missing:
        raise ArchiveError(f"no header {sorted(missing)}")
    length = int(h["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"{len(rest)} bytes follow headers that announce {length}")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError("no end of the HTTP headers")
    announced = int(_headers(http, b"HTTP/").get("content-length", -1))
    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if announced != len(payload):
            raise ArchiveError(f"a payload of {len(payload)} bytes where HTTP announces {announced}")
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ArchiveError("the payload does not have the digest of its record")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in h:
            raise ArchiveError("a revisit has no payload and names the record it refers to")
    else:
        raise ArchiveError(f"record type {kind!r}")
    return {"page_id": _page_of(h["warc-record-id"]), "uri": h.get("warc-target-uri"), "record_type": kind,
            "refers_to": _page_of(h["warc-refers-to"]) if kind == "revisit" else None,
            "payload_bytes": announced, "payload_digest": digest, "payload": payload}


# ---------------------------------------------------------------- archives

def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the first sample as raw content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return samples[0][:DICT_BYTES] if samples else b""


class _Archive:
    """One archive being written: under a name of this attempt, renamed once it is whole."""

    def __init__(self, fs, folder: str, name: str, dictionary: bytes):
        self.fs, self.final, self.records, self.size = fs, f"{folder}/{name}{SUFFIX}", 0, 0
        self.draft = f"{folder}/{name}.{uuid.uuid4().hex}.draft"
        self.out = fs.open_output_stream(self.draft)
        packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
        self._put(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.frames = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.frames.compress(record))
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.draft, self.final)
        return {"archive": [os.path.basename(self.final)], "records": [self.records], "bytes": [self.size]}


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the rows of `plan_records` into `folder`; a row per archive comes back (archive, records, bytes).

    The folder must be one that all executors share. A task that runs again writes the same names
    anew, and files appear only when whole, so lost executors and second attempts leave no halves.
    """
    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") \
            else (pyarrow.fs.LocalFileSystem(), folder)
        fs.create_dir(path, recursive=True)
        part, rolled, archive, dictionary, waiting, held = TaskContext.get().partitionId(), 0, None, None, [], 0
        def rows():
            for columns in batches:
                yield from zip(*columns)
            yield None
        for row in rows():
            if row is not None:
                waiting.append(_record(*row))
                held += len(waiting[-1])
            if dictionary is None and waiting and (row is None or len(waiting) >= DICT_RECORDS or held >= DICT_SAMPLE_BYTES):
                dictionary = _dictionary([w[:DICT_SAMPLE_BYTES // 8] for w in waiting])
            if dictionary is None:
                continue
            for record in waiting:
                archive = archive or _Archive(fs, path, f"part-{part:06d}-{rolled:04d}", dictionary)
                archive.add(record)
                if archive.size >= roll_bytes:
                    yield archive.close()
                    archive, rolled = None, rolled + 1
            waiting = []
        if archive:
            yield archive.close()

    return stage(map_batches(records.select("page_id", "uri", "body", "revisit", "refers_to"), run,
                             "archive string, records long, bytes long"), "warc-manifest")


def _frames(data: bytes, name: str) -> Iterator[bytes]:
    """The decoded records of one archive."""
    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        packed, at = data[8:8 + size], 8 + size
        if len(packed) != size:
            raise ArchiveError(f"{name}: the dictionary frame is cut short")
        raw = zstandard.ZstdDecompressor().decompress(packed) if packed.startswith(ZSTD_MAGIC) else packed
        trained = zstandard.ZstdCompressionDict(raw) if raw else None
    decoder, view = zstandard.ZstdDecompressor(dict_data=trained), memoryview(data)
    while at < len(data):
        frame = decoder.decompressobj()
        parts, step = [], 1 << 16
        while not frame.eof:
            if at >= len(data):
                raise ArchiveError(f"{name}: the last frame is cut short")
            chunk = view[at:at + step]
            parts.append(frame.decompress(chunk))
            at += len(chunk) - len(frame.unused_data)
        yield b"".join(parts)


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row per record of all archives below `folder`, with its payload as binary if asked for.

    Raises ArchiveError in the task when a frame, header, length or digest is wrong.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}")
             .option("recursiveFileLookup", "true").load(folder).select("path", "content"))

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for paths, contents in batches:
            for path, data in zip(paths, contents):
                rows, held = [], 0
                for raw in _frames(data, path):
                    row = parse_record(raw) | {"archive": os.path.basename(path)}
                    held += len(row["payload"]) if payload else 0
                    rows.append(row if payload else {k: v for k, v in row.items() if k != "payload"})
                    if len(rows) >= 4096 or held >= 16 << 20:
                        yield {k: [r[k] for r in rows] for k in rows[0]}
                        rows, held = [], 0
                if rows:
                    yield {k: [r[k] for r in rows] for k in rows[0]}

    return map_batches(files, run, RECORD_COLUMNS + (", payload binary" if payload else ""))


def round_trip(pages: DataFrame, folder: str | None = None, payload: bool = False, **columns) -> DataFrame:
    """Writes `pages` as archives and reads them back. An empty table gives no archive and no row."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    manifest = write_archives(plan_records(pages, **columns), folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD_COLUMNS + (", payload binary" if payload else ""))
    return read_archives(spark, folder, payload)
