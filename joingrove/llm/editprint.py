"""Fingerprints by a randomised edit embedding.

A walk reads a text character by character: at step j it notes the character it stands on and moves on
or stays by a bit that only j and the character decide. All texts share these bits, so two walks that
an edit has parted tend to fall into step again, and edit distance becomes Hamming distance between
what the walks noted. A fingerprint holds the notes of sampled steps. Bands of sampled bits find
candidates, whose edit distance is then verified.

All texts of a task walk side by side in numpy, so a step costs the same few calls for any number of them.
"""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joingrove.llm.common import join_copies, map_batches, stage, texts
from joingrove.operators.long_values import Text, least_edits, within
from joingrove.sources.staging import stage_observed

SLOTS = 128  # sampled steps, a byte each
PERIOD = 4096  # of the shared bits; steps are mixed over it
BLOCK = 512  # steps between two looks at which walks have ended
#: Characters of a task that walk together, and ranges of ids per shuffle partition's worth of rows.
TOGETHER, PER_RANGE = 24 << 20, 1
#: Characters that a text counts for beside its own: steps and notes of its walks take a few kilobytes.
A_TEXT = 1000
#: Edits in a text's length up to which two are near.
SHARE = 0.05
BANDS, BAND_BYTES = 16, 3
#: Share of equal slots below which two texts are not looked at: near ones have about 0.3 and more, others a tenth of that.
NEAR_LEAST = 0.12
MAX_RANGES = 4096


@cache
def _shared() -> tuple[np.ndarray, np.ndarray]:
    """The walk's bits by step and class of character, and the byte noted for a class by step."""
    rng = np.random.default_rng(20240229)
    move = rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    note = rng.integers(1, 256, (PERIOD, 256), dtype=np.uint8)
    move[:, 0], note[:, 0] = 0, 0  # class 0 stands behind the end of each text
    return move, note


def _mix(j: int) -> int:
    return (j * 2654435761 >> 7) % PERIOD


@cache
def _records(slot: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps below 2 ** exponent whose priority in this slot is lower than that of all steps before."""
    steps, out_at, low = 1 << exponent, [], 1 << 64
    for start in range(0, steps, 1 << 20):
        j = np.arange(start, min(start + (1 << 20), steps), dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = (j + np.uint64(0x9E3779B97F4A7C15) * np.uint64(slot + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
        least = np.minimum.accumulate(h)
        first = np.flatnonzero((h == least) & (h < low) & np.concatenate([[True], h[1:] < least[:-1]]))
        out_at += j[first].tolist()
        low = min(low, int(least[-1]))
    return out_at


def sampled_steps(n: int) -> list[int]:
    """For each slot the step of least priority among the first 2 n, about as many as the walk takes.

    Two lengths share a slot's step with the probability of their ratio.
    """
    limit = max(2 * n, 1)
    exponent = max((limit - 1).bit_length(), 10)
    return [at[bisect_left(at, limit) - 1] for at in (_records(s, exponent) for s in range(SLOTS))]


def classes(text: str) -> np.ndarray:
    """A class from 1 to 255 for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).clip(1)


def prints(walkers: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of texts given as classes: a row of SLOTS bytes each; zeros for an empty text."""
    out = np.zeros((len(walkers), SLOTS), np.uint8)
    if not walkers:
        return out
    move, note = _shared()
    order = np.argsort([-len(w) for w in walkers], kind="stable")  # the longest first: those that go on are a prefix
    sizes = np.array([len(walkers[i]) for i in order])
    starts = np.concatenate([[0], (sizes + 1).cumsum()])
    line = np.zeros(starts[-1] + 1, np.uint8)
    for k, i in enumerate(order):
        line[starts[k]:starts[k] + sizes[k]] = walkers[i]
    at = starts[:-1].copy()
    by_size = {n: np.array(sampled_steps(int(n))) for n in np.unique(sizes)}
    steps = np.stack([by_size[n] for n in sizes])
    slots = np.argsort(steps, axis=1, kind="stable")
    wanted = np.take_along_axis(steps, slots, 1)
    done = np.zeros(len(order), np.int64)  # slots of each walk that are filled
    j, alive = 0, int((sizes > 0).sum())
    done[alive:] = SLOTS  # empty texts
    seen = np.empty((BLOCK, alive), np.uint8)
    while alive:
        c, m, p = np.empty(alive, np.uint8), np.empty(alive, np.uint8), at[:alive]
        view = seen[:, :alive]
        for b in range(BLOCK):
            np.take(line, p, out=c)
            view[b] = c
            np.take(move[_mix(j + b)], c, out=m)
            p += m
        last = (wanted[:alive] < j + BLOCK).sum(1)
        for k in np.flatnonzero(last > done[:alive]):
            w = wanted[k, done[k]:last[k]]
            rows = [_mix(int(s)) for s in w]
            out[order[k], slots[k, done[k]:last[k]]] = note[rows, view[w - j, k]]
        done[:alive] = last
        j += BLOCK
        alive = int((done[:alive] < SLOTS).sum())  # shorter texts have earlier last steps, almost in order
        if alive:
            alive = int(np.flatnonzero(done < SLOTS)[-1]) + 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many first code points of the next one, or all it has."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


# ---------------------------------------------------------------- tables

ROW_COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double, shared_bands int, near_by_edits boolean")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of `docs`: its fingerprint, that of its edited text, and both likenesses.

    The next document has the next smaller doc_id; after the last comes the first. Null ids come last;
    rows that share an id follow one another by the hash of their text. A null text counts as empty.
    A document that is alone is its own next. Texts move once: ranges of ids go to tasks, and the first
    document of each range is sent to the range before it as well.

    shared_bands counts the bands in which a text and its edited one agree; where there is one, the pair is a candidate and its edit
    distance is verified: near_by_edits says whether it is at most SHARE of the longer text, and is false without a shared
    band. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = _cuts(rows.select("k"), min(n_parts * PER_RANGE, MAX_RANGES))
    largest = _largest(rows.select("k"), cuts)  # of each range that has rows, at most one entry a range
    if not largest:
        return spark.createDataFrame([], ROW_COLUMNS)
    order = sorted(largest, reverse=True)
    guest = {largest[r]: order[i - 1] for i, r in enumerate(order)}  # where each first document is sent as well
    ranged = rows.withColumn("r", _range_of(F.col("k"), cuts))
    guests = F.create_map(*[F.lit(x) for kv in guest.items() for x in kv])
    own = F.array(F.struct(F.col("r").alias("to"), F.lit(False).alias("guest")))
    both = F.array(F.struct(F.col("r").alias("to"), F.lit(False).alias("guest")),
                   F.struct(guests[F.col("k")].alias("to"), F.lit(True).alias("guest")))
    sent = (ranged.withColumn("to", F.explode(F.when(F.col("k").isin(list(guest)), both).otherwise(own)))
            .select("doc_id", "k", "text", F.col("to.to").alias("to"), F.col("to.guest").alias("guest"))
            .repartitionById(n_parts, F.pmod(F.col("to"), F.lit(n_parts)).cast("int"))
            .sortWithinPartitions("to", "guest", F.col("k").desc(), F.xxhash64("text")))
    return map_batches(sent.select("to", "guest", "doc_id", "k", "text"), _walk_ranges, ROW_COLUMNS)


def _cuts(keys: DataFrame, ranges: int) -> list[int]:
    """Quantiles of the ids, approximate: they only have to make ranges of like size."""
    got = keys.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], max(10 * ranges, 1000)).alias("q")).first()["q"] \
        if ranges > 1 else []
    return sorted(set(got or []))


def _range_of(k, cuts: list[int]):
    """How many cuts lie below or at the id: found by bisection, written as nested conditions."""
    def node(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(k < F.lit(cuts[mid]), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(cuts))


def _largest(keys: DataFrame, cuts: list[int]) -> dict[int, int]:
    return {r["r"]: r["k"] for r in keys.groupBy(_range_of(F.col("k"), cuts).alias("r")).agg(F.max("k").alias("k")).collect()}


def _walk_ranges(batches: Iterator[tuple]) -> Iterator[dict]:
    """Rows come by range, ids falling, the guest last: the next document is the next row."""
    held, size, before = [], 0, None  # before: the row that waits for its next one

    def rows():
        for columns in batches:
            yield from zip(*columns)

    for to, guest, doc_id, k, text in rows():
        if before and before[0] == to:
            # a range of its own that is all there is meets itself as its guest
            held.append((before[1], before[2], text))
            size += 3 * (len(before[2]) + A_TEXT)
            if size > 3 * TOGETHER:
                yield _finish(held)
                held, size = [], 0
        before = None if guest else (to, doc_id, text)
    if held:
        yield _finish(held)


def _finish(held: list[tuple]) -> dict:
    new = [edited(t, f) for _, t, f in held]
    own = [classes(t) for _, t, _ in held]
    walkers, next_at = list(own), []
    for i, (_, t, f) in enumerate(held):
        if i + 1 < len(held) and held[i + 1][1] is f:
            next_at.append(i + 1)
        else:  # the next document is no row of this task's list
            next_at.append(len(walkers))
            walkers.append(classes(f))
    start = len(walkers)
    walkers += [classes(t) for t in new]
    p = prints(walkers)
    mine, theirs, changed = p[:len(held)], p[next_at], p[start:]
    bands = (mine[:, :BANDS * BAND_BYTES].reshape(-1, BANDS, BAND_BYTES)
             == changed[:, :BANDS * BAND_BYTES].reshape(-1, BANDS, BAND_BYTES)).all(2).sum(1)
    return {"doc_id": [d for d, _, _ in held], "n_chars": [len(t) for _, t, _ in held],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
            "fingerprint": [r.tobytes().hex() for r in mine], "edited_fingerprint": [r.tobytes().hex() for r in changed],
            "near_edited": likeness(mine, changed).tolist(), "near_next": likeness(mine, theirs).tolist(),
            "shared_bands": bands.tolist(), "near_by_edits": [bool(b) and near_by_edits(t, e) for b, (_, t, _), e in zip(bands, held, new)]}


# ---------------------------------------------------------------- near texts by bands

def near_by_edits(a: str, b: str, share: float = SHARE) -> bool:
    """Whether the edit distance is at most `share` of the longer text's length.

    What texts begin and end with alike costs no edit. Of the rest, grams that do not stand near their place in the other text
    tell a least number of edits; where that is not too many, the distance is counted.
    """
    limit = int(share * max(len(a), len(b)))
    if a == b:
        return True
    if abs(len(a) - len(b)) > limit:
        return False
    start = len(os.path.commonprefix([a, b]))
    a, b = a[start:], b[start:]
    x, y = Text(a), Text(b)
    if max(least_edits(x, y, 4, limit), least_edits(y, x, 4, limit)) > limit:
        return False
    return within(a, b, limit)


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """doc_id, class_id per row: texts joined by verified links of at most `share` of the longer text's length in edits.

    Equal texts are one class from the start, a null text is empty, rows that repeat get the same class each, and an empty table
    gives no rows. Texts that agree in a band meet in a bucket. Its members are compared with its smallest one; those that are
    not near it go on among themselves, round by round, until no bucket has two of them. Like all banding it finds near
    texts with high probability, not certainty, and a text is only compared with the smallest ones of its buckets.
    """
    from joingrove.llm.components import components

    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for keys, bodies in batches:
            for i in range(0, len(keys), 256):
                p = prints([classes(t) for t in bodies[i:i + 256]])
                yield {"key": keys[i:i + 256], "fp": [r.tobytes().hex() for r in p]}

    def verify(batches: Iterator[tuple]) -> Iterator[dict]:
        for a, b, x, y in batches:
            near = [near_by_edits(s, t, share) for s, t in zip(x, y)]
            yield {"a": a, "b": b, "near": near}

    rows = texts(docs, id_col, text_col)
    distinct, counted = stage_observed(rows.groupBy(F.xxhash64("text").alias("key")).agg(F.min("text").alias("text")), "edit-texts",
                                       F.count(F.lit(1)).alias("n"))
    fps = stage(map_batches(distinct.select("key", "text"), run, "key long, fp string"), "edit-prints")
    bands = [F.xxhash64(F.lit(k), *[F.substring("fp", 1 + 2 * slot, 2) for slot in slots]) for k, slots in enumerate(near_bands(int(counted["n"] or 0)))]
    active, found = fps.select("key", F.explode(F.array(*bands)).alias("bucket")), None
    while True:
        heads, seen = stage_observed(active.groupBy("bucket").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"),
                                     "edit-heads", F.sum("n").alias("rows"))
        if not seen["rows"]:
            break
        members = stage(join_copies(active, heads.select("bucket", "b"), "bucket", heads, int(seen["rows"])).where("key != b"), "edit-members")
        pairs = members.select(F.col("key").alias("a"), "b").distinct()
        alike = sum(((F.substring("p", 1 + 2 * i, 2) == F.substring("q", 1 + 2 * i, 2)).cast("int") for i in range(SLOTS)), F.lit(0))
        pairs = (pairs.join(fps.toDF("a", "p"), "a").join(fps.toDF("b", "q"), "b").where(alike >= NEAR_LEAST * SLOTS).select("a", "b"))
        left, right = distinct.toDF("a", "x"), distinct.toDF("b", "y")
        near = stage(map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), verify, "a long, b long, near boolean")
                     .where("near").select("a", "b"), "edit-links")
        found = near if found is None else found.unionByName(near)
        active = stage(members.join(near.select(F.col("a").alias("key"), "b"), ["key", "b"], "left_anti").select("bucket", "key"), "edit-left")
    named = rows.select("doc_id", F.xxhash64("text").alias("node"))
    if found is None:
        return named.withColumnRenamed("node", "class_id")
    return named.join(components(found), "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))


def near_bands(n: int) -> list[tuple[int, ...]]:
    """Slots of the bands in which near texts are searched: two a band for up to 65,536 texts, one more for each 256 times as many,
    so that texts unlike each other seldom meet; and four times the bands for each, so that near ones do as often."""
    size = max(2, -(-max(n - 1, 1).bit_length() // 8))
    rng, out = np.random.default_rng(11), []
    for _ in range(2 * 4 ** (size - 2)):
        order = rng.permutation(SLOTS)
        out += [tuple(map(int, order[i:i + size])) for i in range(0, SLOTS - size + 1, size)]
    return out
