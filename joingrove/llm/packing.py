"""Packing of tokenized documents into sequences of a fixed length.

Documents become pieces of at most one sequence. How many pieces there are of each length is all that
packing needs: a table of at most CAPACITY numbers, however many documents there are. On it sets of
pieces that provably dominate every alternative are fixed first (Martello and Toth's reduction),
best fit decreasing places the rest, and pieces then take their places by their rank among equals.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from joingrove.llm.common import map_batches, stage, texts

CAPACITY, END = 2048, 0
#: Pieces of one length that are ranked in one task.
RANKED = 200_000
#: Words whose ids a worker remembers.
REMEMBER = 500_000

PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens

def tokenizer_path() -> str:
    """The ranks of the byte-level BPE vocabulary; they give the ids of byte_bpe_50k.json."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids as little-endian bytes. Added tokens in a text keep their ids in `with_added`; in `batch` they are ordinary text.

    Where all white space is single blanks and line ends, words between them are encoded once and
    remembered: the vocabulary's split never joins what such a blank separates. Other texts are encoded whole.
    """
    _together = ("  ", "\n\n", " \n", "\n ")
    _other_space = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
    _other_ascii = tuple(c for c in _other_space if c.isascii())

    def __init__(self, path: str):
        import public_tokenizers
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in json.load(f)["added_tokens"]}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.line = self.whole("\n")
        self.line_id = int(np.frombuffer(self.line, "<u4")[0])
        # By word: the ids of a blank and the word, or, with a line end in front, of the line end and the word.
        self.known = {"": self.whole(" "), "\n": self.line}

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def plain(self, text: str) -> bool:
        """Whether all white space is single blanks and line ends."""
        other = self._other_ascii if text.isascii() else self._other_space
        return not any(c in text for c in self._together) and not any(c in text for c in other)

    def with_added(self, bodies: list[str]) -> list[bytes]:
        """The ids of the library's default setting: texts are split at added tokens, what lies between is encoded alone."""
        parts = [self.cuts.split(t) if any(a in t for a in self.added) else [t] for t in bodies]
        between = iter(self.batch([p for own in parts for p in own[::2]]))
        return [b"".join(self.added[p] if i % 2 else next(between) for i, p in enumerate(own)) for own in parts]

    def batch(self, bodies: list[str]) -> list[bytes]:
        waiting, missing = [], set()
        for t in bodies:
            if not self.plain(t):
                waiting.append((t, None))
                continue
            names = []
            for line in t.split("\n"):
                words = line.split(" ")
                words[0] = "\n" + words[0]
                names += words
            ids = list(map(self.known.get, names))
            gaps = [(i, names[i]) for i, found in enumerate(ids) if found is None]
            missing.update(name for _, name in gaps)
            waiting.append((ids, gaps))
        new = list(missing)
        fresh = dict(zip(new, self._each(new)))
        if len(self.known) + len(fresh) <= REMEMBER:
            self.known.update(fresh)
        out = []
        for ids, gaps in waiting:
            if gaps is None:
                out.append(self.whole(ids))
                continue
            for i, name in gaps:
                ids[i] = fresh[name]
            out.append(b"".join(ids)[4:])  # the first line has no line end before it
        return out

    def _each(self, names: list[str]) -> Iterator[bytes]:
        """Many words at once, with line ends between them, which nothing merges with."""
        for i in range(0, len(names), 20_000):
            some = names[i:i + 20_000]
            ids = np.array(self.bpe.encode_ordinary("\n".join([n[1:] if n[0] == "\n" else " " + n for n in some])), "<u4")
            data, ends = ids.tobytes(), np.append(np.flatnonzero(ids == self.line_id), len(ids)) * 4
            starts = np.append(0, ends[:-1] + 4)
            for name, start, end in zip(some, starts.tolist(), ends.tolist()):
                yield self.line + data[start:end] if name[0] == "\n" else data[start:end]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           path: str | None = None) -> DataFrame:
    """The pieces of each row of `docs`: doc_id, piece, start, length, ids_crc32. Each document ends in id 0."""
    path = path or tokenizer_path()

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, bodies in batches:
            out = {c.split()[0]: [] for c in PIECE_COLUMNS.split(", ")}
            for i in range(0, len(ids), 1000):
                for doc_id, data in zip(ids[i:i + 1000], encoder(path).with_added(bodies[i:i + 1000])):
                    data += END.to_bytes(4, "little")
                    for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        crc = crc32(memoryview(data)[4 * start:4 * (start + length)])
                        for c, v in zip(out, (doc_id, k, start, length, crc)):
                            out[c].append(v)
            yield out

    return map_batches(texts(docs, id_col, text_col), run, PIECE_COLUMNS)


# ---------------------------------------------------------------- the plan, from counts by length

def dominating(counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Sets of lengths fixed with how often; `counts` (by length) keeps what is left.

    From the longest length j down, with room r = capacity - j: a set dominates all sets that hold j if
    each of those can be mapped into it part by part, so some best packing has it as a sequence.
    - Nothing fits beside j: {j}.
    - One piece of length r fits: {j, r}, since all that stands beside j in any set fits into r.
    - At most one piece fits beside j (the two shortest exceed r): {j, k}, k the longest that fits.
    - At most two fit (the three shortest exceed r): {j, k} if no two that fit together are longer than
      k; else {j, k, b} with b the longest that still fits, if no two pieces that are both longer than b fit.
    """
    fixed = []
    for j in range(capacity, 0, -1):
        while counts[j]:
            found = _dominating_set(counts, j, capacity - j)
            if found is None:
                break
            need = {s: found.count(s) for s in found}
            # A set may be fixed again while the same pieces are there; the shortest ones decide the rule
            # and only lengthen as pieces go, so what dominated goes on to.
            times = min(counts[s] // c for s, c in need.items())
            for s, c in need.items():
                counts[s] -= c * times
            fixed.append((found, times))
    return fixed


def _dominating_set(counts: list[int], j: int, r: int) -> list[int] | None:
    def there(s: int) -> int:
        return counts[s] - (s == j)

    def longest(room: int, less: int | None = None) -> int:
        return next((s for s in range(room, 0, -1) if there(s) - (s == less) > 0), 0)

    if r == 0 or not (k := longest(r)):
        return [j]
    if k == r:
        return [j, k]
    short: list[int] = []  # the three shortest pieces beside j
    for s in range(1, r + 1):
        short += [s] * min(there(s), 3 - len(short))
        if len(short) == 3:
            break
    if len(short) < 2 or short[0] + short[1] > r:
        return [j, k]
    if len(short) == 3 and sum(short) <= r:
        return None
    pair = max((s + b for s in range(1, r) if there(s) > 0 and (b := longest(min(s, r - s), s))), default=0)
    if pair <= k:
        return [j, k]
    b = longest(r - k, k)
    above = [s for s in range(b + 1, r + 1) for _ in range(min(there(s), 2))][:2]
    return [j, k, b] if b and (len(above) < 2 or sum(above) > r) else None


def best_fit(counts: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing on counts: (contents as (length, times) in order, how many such sequences).

    Equal sequences are one entry. A piece goes where it leaves least room; having taken one, that
    sequence has the least room still, so it takes as many of the length as fit.
    """
    open_by_room: dict[int, list[tuple[list, int]]] = {}
    rooms: list[int] = []

    def put(room: int, contents: list, n: int) -> None:
        if n:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((contents, n))

    for s in range(capacity, 0, -1):
        left, counts[s] = counts[s], 0
        at = bisect_left(rooms, s)
        while left and at < len(rooms):
            room = rooms[at]
            entries, fit = open_by_room[room], room // s
            while left and entries:
                contents, n = entries.pop()
                whole = min(n, left // fit)
                put(room - fit * s, [*contents, (s, fit)], whole)
                n, left = n - whole, left - whole * fit
                if n and left:  # fewer are left than one sequence takes
                    put(room - left * s, [*contents, (s, left)], 1)
                    n, left = n - 1, 0
                if n:
                    entries.append((contents, n))
            if not entries:
                del open_by_room[room]
                rooms.remove(room)
            at = bisect_left(rooms, room + (1 if room in open_by_room else 0))
            at = max(at, bisect_left(rooms, s))
        fit = capacity // s
        put(capacity - fit * s, [(s, fit)], left // fit)
        if left % fit:
            put(capacity - left % fit * s, [(s, left % fit)], 1)
    return [e for room in rooms for e in open_by_room[room]]


def plan(counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, times, first sequence, offset): where the pieces of each length go by their rank.

    Ranks from `first rank` on fill sequences from `first sequence` on, `times` pieces in each, the first at `offset`.
    """
    counts = list(counts)
    groups = [([(s, found.count(s)) for s in dict.fromkeys(found)], n) for found, n in dominating(counts, capacity)]
    groups += best_fit(counts, capacity)
    rows, sequence, rank = [], 0, {}
    for contents, n in groups:
        offset = 0
        for s, times in contents:
            rows.append((s, rank.get(s, 0), times, sequence, offset))
            rank[s] = rank.get(s, 0) + n * times
            offset += s * times
        sequence += n
    return sorted(rows)


# ---------------------------------------------------------------- tables

def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut_pieces` (doc_id, piece, length, ...) with sequence_id and offset. Lengths lie in 1 to `capacity`.

    Only counts by length reach the driver. Ranks within a length come from salted parts of bounded
    size, so any share of the documents may have one length.
    """
    rows = stage(cut_pieces, "pieces")
    counts = [0] * (capacity + 1)
    for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    parts = rows.sparkSession.createDataFrame([(s, n // RANKED + 1) for s, n in enumerate(counts) if n] or [(1, 1)], "length long, _parts int")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_parts")).cast("int")
    salted = rows.join(F.broadcast(parts), "length").withColumn("_part", salt).drop("_parts")
    before = (salted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_part")
                                                                 .rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .drop("_n"))
    within = F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (salted.withColumn("_row", within).join(before, ["length", "_part"])
              .withColumn("_rank", F.col("_row") - 1 + F.col("_before")).drop("_row", "_before", "_part"))

    table = plan(counts, capacity)
    keys = np.array([(s << 40) + first for s, first, *_ in table], np.int64)
    numbers = np.array([(first, times, seq, off) for _, first, times, seq, off in table], np.int64).reshape(-1, 4)
    names = rows.columns

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for columns in batches:
            out = dict(zip([*names, "_rank"], columns))
            length, rank = np.array(out["length"], np.int64), np.array(out.pop("_rank"), np.int64)
            first, times, sequence, offset = numbers[np.searchsorted(keys, (length << 40) + rank, "right") - 1].T
            nth, within_sequence = np.divmod(rank - first, times)
            yield out | {"sequence_id": (sequence + nth).tolist(), "offset": (offset + within_sequence * length).tolist()}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_batches(ranked.select(*names, "_rank"), run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is the end id alone."""
    return pack(pieces(docs, id_col, text_col, capacity, path), capacity)
