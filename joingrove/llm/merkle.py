"""A manifest of a table as a tree of SHA-256 digests whose parents keep copied hash states.

A parent is the hash of the hex digests of its run of up to eight children. A hex digest is just one block of
SHA-256, so before each child's slot the hash is nothing but eight words of state, and a parent keeps a copy of
them. To see what a changed row does to the root, the state before its slot is resumed with the replacement and
the siblings to the right: nothing to the left is hashed again, and so on upwards.

Subtrees of three levels (up to 512 nodes, a chunk) are built and folded by one task, many chunks side by side in
numpy; a tree of any size takes one round of jobs for three levels. What stands above a chunk (its path) is a few
hundred bytes a level and is handed down from round to round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from joingrove.llm.common import map_batches, stage
from joingrove.sources.staging import stage_observed

RUN, LEVELS = 8, 3
CHUNK = RUN ** LEVELS
#: Chunks that a task holds together (about 60 KB each), and rows per range of the sorted leaves.
TOGETHER, PER_RANGE = 64, 1_000_000
#: Hash states worked on at once, so that they stay in a core's cache.
LANES = 4096


# ---------------------------------------------------------------- SHA-256 over many states

def _primes(n: int) -> list[int]:
    return [p for p in range(2, 400) if all(p % q for q in range(2, math.isqrt(p) + 1))][:n]


def _cube_root(x: int) -> int:
    r = 1 << -(-x.bit_length() // 3)
    while r * r * r > x:
        r = (2 * r + x // (r * r)) // 3
    return r


#: The constants of the standard: first bits of the fractions of the square and cube roots of the first primes.
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_PAIRS = np.frombuffer(b"".join(b"%04x" % i for i in range(1 << 16)), ">u4").astype(np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, n) after a further block (16, n) each, all of uint32."""
    out = np.empty_like(state)
    for i in range(0, state.shape[1], LANES):
        w = list(block[:, i:i + LANES])
        own = state[:, i:i + LANES]
        a, b, c, d, e, f, g, h = own
        for t in range(64):
            if t >= 16:
                x, y = w[(t - 15) % 16], w[(t - 2) % 16]
                w[t % 16] = (w[t % 16] + w[(t - 7) % 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)))
                             + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
            one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t % 16]
            two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
            a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
        out[:, i:i + LANES] = own + np.stack([a, b, c, d, e, f, g, h])
    return out


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The hex text of digests (8, n) as blocks (16, n)."""
    block = np.empty((16, digests.shape[1]), np.uint32)
    block[0::2], block[1::2] = _PAIRS[digests >> np.uint32(16)], _PAIRS[digests & np.uint32(0xFFFF)]
    return block


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of states that have taken in `blocks` whole blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0], last[15] = 0x80000000, blocks * 512
    return compress(state, last)


def _from_bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(np.uint32)


def _to_bytes(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def parents(nodes: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests (8, runs) of runs of nodes (8, n), and the states (8, runs, RUN) before each child's slot."""
    state = np.repeat(START[:, None], len(first), 1)
    before = np.zeros((8, len(first), RUN), np.uint32)
    for slot in range(RUN):
        here = np.flatnonzero(count > slot)
        before[:, here, slot] = state[:, here]
        if len(here):
            state[:, here] = compress(state[:, here], hex_block(nodes[:, first[here] + slot]))
    return finish(state, count), before


def fold(node: np.ndarray, before: np.ndarray, slot: np.ndarray, count: np.ndarray, right) -> np.ndarray:
    """Parents' digests where `node` stands in `slot`: their states before it, resumed. `right(k, rows)` has the k-th sibling to the right."""
    state = compress(before, hex_block(node))
    for k in range(1, RUN):
        here = np.flatnonzero(slot + k < count)
        if not len(here):
            break
        state[:, here] = compress(state[:, here], hex_block(right(k, here)))
    return finish(state, count)


# ---------------------------------------------------------------- chunks of three levels

def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks with so many nodes each, laid end to end: first node and size of each run, and runs per chunk."""
    per = -(-sizes // RUN)
    start = np.repeat(sizes.cumsum() - sizes, per) + (np.arange(per.sum()) - np.repeat(per.cumsum() - per, per)) * RUN
    end = np.repeat(sizes.cumsum(), per)
    return start, np.minimum(end - start, RUN), per


BUILT = "g string, chunk long, levels int, deep int, ids array<long>, nodes binary, other binary, inner binary, states binary, top binary"


def _build(columns: Iterator[tuple]) -> Iterator[dict]:
    """Rows (g, chunk, levels, deep, id, digest, other) in the order of g, chunk and place become a row per chunk."""
    held: list[list] = []
    for batch in columns:
        for g, chunk, levels, deep, i, digest, other in zip(*batch):
            if not held or held[-1][0] != g or held[-1][1] != chunk:
                if len(held) == TOGETHER:
                    yield _built(held)
                    held = []
                held.append([g, chunk, levels, deep, [], [], []])
            row = held[-1]
            row[4].append(i)
            row[5].append(digest)
            row[6].append(other)
    if held:
        yield _built(held)


def _built(held: list[list]) -> dict:
    nodes = _from_bytes(b"".join(d for row in held for d in row[5]))
    sizes, levels = np.array([len(row[5]) for row in held]), np.array([row[2] for row in held])
    inner, states = [[] for _ in held], [[] for _ in held]
    top = [row[5][0] for row in held]
    for level in range(LEVELS):
        up = np.flatnonzero(levels > level)
        if not len(up):
            break
        keep = np.repeat(levels > level, sizes)
        nodes, sizes = nodes[:, keep] if not keep.all() else nodes, np.where(levels > level, sizes, 0)
        first, count, per = _runs(sizes)
        nodes, before = parents(nodes, first, count)
        digests, kept = _to_bytes(nodes), np.ascontiguousarray(before.transpose(1, 2, 0)).astype(">u4").tobytes()
        at = np.concatenate([[0], per.cumsum()])
        for c in up:
            inner[c].append(digests[at[c] * 32:at[c + 1] * 32])
            states[c].append(kept[at[c] * RUN * 32:at[c + 1] * RUN * 32])
            top[c] = digests[at[c] * 32:at[c] * 32 + 32]
        sizes = per
    return {"g": [r[0] for r in held], "chunk": [r[1] for r in held], "levels": [r[2] for r in held], "deep": [r[3] for r in held],
            "ids": [r[4] for r in held], "nodes": [b"".join(r[5]) for r in held],
            "other": [b"".join(o or d for o, d in zip(r[6], r[5])) for r in held],
            "inner": [b"".join(x) for x in inner], "states": [b"".join(x) for x in states], "top": top}


class _Chunk:
    """A chunk as it was built: digests and states by level."""

    def __init__(self, levels: int, nodes: bytes, inner: bytes, states: bytes) -> None:
        self.levels, self.hashed, self.states, at = levels, [nodes], [], 0
        for _ in range(levels):
            n = -(-len(self.hashed[-1]) // (32 * RUN))
            self.hashed.append(inner[at * 32:(at + n) * 32])
            self.states.append(states[at * RUN * 32:(at + n) * RUN * 32])
            at += n

    def step(self, level: int, i: int) -> bytes:
        """How node `i` of a level stands in its run: the state before it, its slot, the run's size, the others."""
        run, slot = divmod(i, RUN)
        children = self.hashed[level][run * RUN * 32:(run + 1) * RUN * 32]
        return (self.states[level][i * 32:i * 32 + 32] + bytes([slot, len(children) // 32])
                + children[:slot * 32] + children[slot * 32 + 32:])

    def steps(self, i: int) -> list[bytes]:
        return [self.step(level, i // RUN ** level) for level in range(self.levels)]


PATHS = "g string, idx long, path array<binary>, subroot binary, root binary"


def _paths(columns: Iterator[tuple]) -> Iterator[dict]:
    """Chunks with the path above them become a row per node with the path above it; a null subroot is the node itself."""
    for batch in columns:
        for g, chunk, levels, nodes, inner, states, path, subroot, root in zip(*batch):
            c, n = _Chunk(levels, nodes, inner, states), len(nodes) // 32
            yield {"g": [g] * n, "idx": [chunk * CHUNK + i for i in range(n)], "path": [c.steps(i) + (path or []) for i in range(n)],
                   "subroot": [subroot or nodes[i * 32:i * 32 + 32] for i in range(n)], "root": [root] * n}


FOLDED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(columns: Iterator[tuple]) -> Iterator[dict]:
    """Chunks of leaves with the path above them become a row per leaf."""
    for batch in columns:
        rows = list(zip(*batch))
        for i in range(0, len(rows), TOGETHER):
            yield _proved(rows[i:i + TOGETHER])


def _proved(rows: list[tuple]) -> dict:
    out = {name.split()[0]: [] for name in FOLDED.split(", ")}
    chunks = [_Chunk(levels, nodes, inner, states) for levels, _, nodes, _, inner, states, _, _, _ in rows]
    for c, (_, ids, nodes, _, _, _, path, subroot, root) in zip(chunks, rows):
        tails = [b"".join(step[34:] for step in path).hex().encode()]  # of the siblings above each node of a level
        for level in range(c.levels - 1, 0, -1):
            tails = [c.step(level, i)[34:].hex().encode() + tails[i // RUN] for i in range(len(c.hashed[level]) // 32)]
        n = len(ids)
        own = [c.step(0, i)[34:].hex().encode() + tails[i // RUN] for i in range(n)] if c.levels else tails * n
        out["proof_sha256"] += [hashlib.sha256(p).hexdigest() for p in own]
        out["doc_id"] += ids
        out["leaf"] += [nodes[i * 32:i * 32 + 32].hex() for i in range(n)]
        out["subroot"] += [subroot.hex()] * n
        out["root"] += [root.hex()] * n
    out["folded_root"] = _folded(chunks, rows)
    out["verified"] = [a == b for a, b in zip(out["folded_root"], out["root"])]
    return out


def _folded(chunks: list[_Chunk], rows: list[tuple]) -> list[str]:
    """The roots that the leaves' other versions lead to, all leaves side by side."""
    sizes, levels = np.array([len(r[1]) for r in rows]), np.array([c.levels for c in chunks])
    of = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(of)) - np.repeat(sizes.cumsum() - sizes, sizes)
    node = _from_bytes(b"".join(r[3] for r in rows))
    for level in range(LEVELS):
        go = np.flatnonzero(levels[of] > level)
        if not len(go):
            break
        width = [len(c.hashed[level]) // 32 if c.levels > level else 0 for c in chunks]
        start = np.concatenate([[0], np.cumsum(width)])
        hashed = _from_bytes(b"".join(c.hashed[level] for c in chunks if c.levels > level))
        states = _from_bytes(b"".join(c.states[level][:w * 32] for c, w in zip(chunks, width) if c.levels > level))
        i = at[go] // RUN ** level
        slot, base = i % RUN, start[of[go]]
        count = np.minimum(np.array(width)[of[go]] - (i - slot), RUN)
        node[:, go] = fold(node[:, go], states[:, base + i], slot, count, lambda k, here: hashed[:, (base + i)[here] + k])
    for step in range(max(len(r[6]) for r in rows)):
        up = [c for c, r in enumerate(rows) if len(r[6]) > step]
        steps = [rows[c][6][step] for c in up]
        place = np.full(len(rows), -1)
        place[up] = np.arange(len(up))
        go = np.flatnonzero(place[of] >= 0)
        states = _from_bytes(b"".join(s[:32] for s in steps))
        slots, counts = np.array([s[32] for s in steps]), np.array([s[33] for s in steps])
        others = _from_bytes(b"".join(s[34:] + bytes((RUN - s[33]) * 32) for s in steps))  # RUN - 1 places each
        p = place[of[go]]
        node[:, go] = fold(node[:, go], states[:, p], slots[p], counts[p],
                           lambda k, here: others[:, p[here] * (RUN - 1) + slots[p[here]] + k - 1])
    raw = _to_bytes(node)
    return [raw[i * 32:i * 32 + 32].hex() for i in range(len(of))]


# ---------------------------------------------------------------- tables

def encoded(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value; numbers as decimals."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _placed(rows: DataFrame, order: list[str], parts: int, label: str) -> DataFrame:
    """Adds idx, a row's place within its g by `order` from 0, and deep, how many levels a tree over the rows of g has.

    Rows are sorted over ranges of (g, order); a g of any size is spread over ranges, of which only sizes meet.
    """
    ranged = rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)
    seen = stage(ranged.withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33)
    runs = seen.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    line = W.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(line.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("rows").over(line)
    deep = sum(((n > RUN ** level).cast("int") for level in range(1, 21)), (n > 1).cast("int"))
    runs = runs.select("g", "part", (before - F.col("first")).alias("shift"), deep.alias("deep"))
    return (seen.withColumn("part", part).join(runs, ["g", "part"])
            .withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift"))


def _tree(nodes: DataFrame, parts: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The chunks of each round, and the top of each g, from rows of g, idx, deep, id, digest and other (may be null)."""
    rounds, tops = [], []
    while True:
        done = LEVELS * len(rounds)
        chunk = F.floor(F.col("idx") / CHUNK).cast("long")
        sent = (nodes.select("g", chunk.alias("chunk"), F.least(F.col("deep") - done, F.lit(LEVELS)).cast("int").alias("levels"), "deep",
                             "id", "digest", "other", "idx")
                .repartition(max(parts // CHUNK ** min(len(rounds), 1), 1), "g", "chunk").sortWithinPartitions("g", "chunk", "idx").drop("idx"))
        built, seen = stage_observed(map_batches(sent, _build, BUILT), f"{label}-{len(rounds)}", F.max("deep").alias("deep"))
        rounds.append(built)
        tops.append(built.where(F.col("deep") <= done + LEVELS).select("g", "top"))
        if (seen["deep"] or 0) <= done + LEVELS:
            break
        nodes = built.where(F.col("deep") > done + LEVELS).select(
            "g", F.col("chunk").alias("idx"), "deep", F.lit(None).cast("long").alias("id"), F.col("top").alias("digest"),
            F.lit(None).cast("binary").alias("other"))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return rounds, out


def _above(chunks: DataFrame, paths: DataFrame, whole: DataFrame, last: bool, done: int) -> DataFrame:
    """Chunks with the path above them: of the node they became one round later, or of their g where they are its top."""
    top = chunks.where(F.col("deep") <= done).join(whole, "g")
    if last:
        return top
    inside = chunks.where(F.col("deep") > done).join(paths.withColumnRenamed("idx", "chunk"), ["g", "chunk"])
    return top.unionByName(inside.select(top.columns))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
             columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row per row of `docs`.

    A leaf hashes `columns` in order. The leaves of a group ascend by id (null first; rows of one id by their leaf, and equal
    rows stand side by side), and runs of eight become parents until one is left, the subroot; a leaf alone is its
    subroot. Subroots in the order of the groups (null first) give the root in the same way. Rows whose id's CRC-32 is
    a multiple of three are folded with the A-Z of their text lowered, others, and all with a null id, as they are;
    a null text stays null. An empty table gives no rows. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digest = lambda text: F.unhex(F.sha2(F.concat(*[encoded(text if c == text_col else F.col(c)) for c in columns]), 256))
    key = F.col(id_col).cast("long")
    changed = (F.crc32(key.cast("string")) % 3 == 0) & (F.col(text_col) != lowered)
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-")).alias("g"), key.alias("id"),
                         digest(F.col(text_col)).alias("digest"), F.when(changed, digest(lowered)).alias("other"),
                         F.monotonically_increasing_id().alias("row"))
    leaves, seen = stage_observed(leaves, "merkle-leaves", F.count(F.lit(1)).alias("n"))
    n = int(seen["n"] or 0)
    if not n:
        return spark.createDataFrame([], FOLDED)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PER_RANGE + 1)
    # equal rows of one id are told apart by `row`, so that no range has to hold all of them
    placed = _placed(leaves, ["id", "digest", "row"], parts, "merkle-sorted").drop("row")
    rounds, subroots = _tree(placed, parts, "merkle-tree")

    subroots = stage(subroots, "merkle-subroots")
    groups = _placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("digest")), ["name"], 1
                     if n < PER_RANGE else parts, "merkle-groups")
    groups = stage(groups, "merkle-named")
    over, root = _tree(groups.select("g", "idx", "deep", F.lit(None).cast("long").alias("id"), "digest", F.lit(None).cast("binary").alias("other")),
                       1 if n < PER_RANGE else parts, "merkle-root")
    whole = root.select("g", F.array().cast("array<binary>").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("top").alias("root"))
    paths = _handed_down(spark, over, whole)
    named = stage(paths.join(groups.select("idx", "name"), "idx").select(F.col("name").alias("g"), "path", "subroot", "root"), "merkle-whole")

    for r in range(len(rounds) - 1, 0, -1):
        paths = stage(_down(rounds[r], paths, named, r == len(rounds) - 1, r), f"merkle-paths-{r}")
    above = _above(rounds[0], paths, named, len(rounds) == 1, LEVELS)
    return map_batches(above.select("levels", "ids", "nodes", "other", "inner", "states", "path", "subroot", "root"), _prove, FOLDED)


def _down(chunks: DataFrame, paths: DataFrame, whole: DataFrame, last: bool, r: int) -> DataFrame:
    above = _above(chunks, paths, whole, last, LEVELS * (r + 1))
    return map_batches(above.select("g", "chunk", "levels", "nodes", "inner", "states", "path", "subroot", "root"), _paths, PATHS)


def _handed_down(spark: SparkSession, rounds: list[DataFrame], whole: DataFrame) -> DataFrame:
    """The path of every node of the lowest round."""
    paths = whole
    for r in range(len(rounds) - 1, -1, -1):
        paths = stage(_down(rounds[r], paths, whole, r == len(rounds) - 1, r), f"merkle-over-{r}")
    return paths
