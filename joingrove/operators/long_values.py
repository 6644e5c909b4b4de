"""Near-equal long strings: which columns hold a value within a distance of a given one.

A fifth of a long string may differ, so no part of it need be found whole and no index leads to its partners.
Strings of like length therefore meet block by block, and the limit is tested in steps that are cheap first:
counts of hashed grams, then the distances of many pairs side by side until they are beyond it with what the grams
of the rest take. For the few that stay, the number of edits that it takes to explain the grams which the other string
does not have near their place, then the distance itself. A string is through when every column has shown a partner.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from joingrove.sources.shipping import ship

# Characters of the strings of one side that a task compares; each counts as LEAST at least. A string is copied for each
# block of the other side that it meets: blocks bound the memory of a task, few of them the disk.
LEFT_CHARS, RIGHT_CHARS, LEAST = 1 << 24, 1 << 23, 1500
# Buckets that grams of one to three characters are counted in, by their size.
BUCKETS = {1: 128, 2: 256, 3: 1024}
POSITION_BITS = 31
# Pairs that wait for one another, those compared side by side (fewer where they fill more than CELLS words), and how few
# are left to be compared one by one; the likeliest of a string that go before its others; rows of the table of edit
# distances that a word holds.
POOL, SIDE_BY_SIDE, CELLS, FEW, FIRST, ROWS = 1 << 16, 1 << 13, 1 << 21, 32, 4, 64
# Columns from one that is looked at to the next.
STRIDE = 8
# Sixteenths of a string behind which its grams are counted once more.
BEHIND = 5


def near_long_columns(values: DataFrame, words: int, slack: float, short: int) -> DataFrame:
    """md5, s0, s1, ...: the columns that hold a near-equal string, for the values that have one.

    `values` has distinct `chars`, the bitmaps w0, w1, ... of the columns that hold them, and c0, c1, ... of the
    columns that do not matter. Two strings of at most `short` characters are not compared with one another.
    """
    spark = values.sparkSession
    ship(spark)
    bits = range(words)
    # A class of lengths is a little wider than near strings may differ, so they are of one or of two that follow.
    step = math.log(1 / (1 - slack)) * (1 + 1e-9)
    rows = values.withColumn("md5", F.md5("chars")).withColumn("class", F.floor(F.log(F.length("chars")) / step).cast("int"))
    open_ = " OR ".join(f"(~(w{i} | c{i})) != 0" for i in bits)
    weight = F.sum(F.greatest(F.length("chars"), F.lit(LEAST)))
    # A row per class: some tens, a few hundred at most.
    found = {r["class"]: r for r in rows.groupBy("class").agg(F.sum(F.when(F.expr(open_), F.greatest(F.length("chars"), F.lit(LEAST)))).alias("left"),
                                                              weight.alias("right")).collect()}
    about = {b: [a for a in (b - 1, b, b + 1) if a in found and found[a]["left"]] for b in found}
    blocks = [(b, -(-sum(found[a]["left"] for a in near) // LEFT_CHARS), -(-found[b]["right"] // RIGHT_CHARS)) for b, near in about.items() if near]
    if not blocks:
        return spark.createDataFrame([], ", ".join(["md5 string"] + [f"s{i} long" for i in bits]))
    reach = F.broadcast(spark.createDataFrame([(a, *block) for block in blocks for a in about[block[0]]], "a int, b int, i_of int, j_of int"))
    bitmap, closed = [f"w{i}" for i in bits], [f"c{i}" for i in bits]
    own = F.pmod(F.xxhash64("md5"), F.lit(1 << 30))
    left = (rows.where(open_).join(reach, F.col("class") == F.col("a"))
            .select("b", F.pmod(own, F.col("i_of")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_of") - 1)).alias("j"),
                    "md5", "chars", *bitmap, *closed))
    right = (rows.join(F.broadcast(spark.createDataFrame(blocks, "b int, i_of int, j_of int")), F.col("class") == F.col("b"))
             .select("b", F.explode(F.sequence(F.lit(0), F.col("i_of") - 1)).alias("i"), F.pmod(own, F.col("j_of")).cast("int").alias("j"),
                     "md5", "chars", *bitmap))
    keys = ["b", "i", "j"]
    # By a fixed number: tasks are dear by their comparisons, not by the bytes they read.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    right = right.toDF(*right.columns)  # both sides come from the same columns
    pairs = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys))
    schema = ", ".join(["md5 string"] + [f"s{i} long" for i in bits])
    seen = pairs.applyInPandas(lambda x, y: _compared(x, y, words, slack, short), schema)
    return seen.groupBy("md5").agg(*[F.expr(f"bit_or(s{i}) AS s{i}") for i in bits])


# -- within a task -------------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """32-bit hashes of the grams of a string, in order."""
    n = max(len(codes) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ codes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.int64)


def _counts(codes: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(_grams(codes, size) % buckets, minlength=buckets).astype(np.float32) for size, buckets in BUCKETS.items()]


class Text:
    """A string with its places of grams, made when first asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.codes = text, _codes(text)
        self.size = len(self.codes)
        self._grams: dict[int, np.ndarray] = {}
        self._places: dict[int, np.ndarray] = {}

    def grams(self, size: int) -> np.ndarray:
        if size not in self._grams:
            self._grams[size] = _grams(self.codes, size)
        return self._grams[size]

    def places(self, size: int) -> np.ndarray:
        if size not in self._places:
            g = self.grams(size)
            self._places[size] = np.sort((g << POSITION_BITS) + np.arange(len(g)))
        return self._places[size]


def least_edits(x: Text, y: Text, size: int, limit: int) -> int:
    """A number of edits that turning x into y takes at least, if it takes `limit` or fewer (counted up to limit + 1).

    A gram of x that no edit touches stands in y, moved by s; s edits moved it there and as many as the rest of the
    difference in length follow. Of grams that do not, those that do not overlap need an edit each.
    """
    g = x.grams(size)
    if not len(g):
        return 0
    more = y.size - x.size
    low, high = -((limit - more) // 2), (limit + more) // 2
    at, places = np.arange(len(g)), y.places(size)
    if not len(places):
        missing = at
    else:
        first = np.searchsorted(places, (g << POSITION_BITS) + np.maximum(at + low, 0))
        stands = (first < len(places)) & (places[np.minimum(first, len(places) - 1)] <= (g << POSITION_BITS) + np.maximum(at + high, -1))
        stands &= at + high >= 0
        missing = np.flatnonzero(~stands)
    following = np.searchsorted(missing, missing + size).tolist()
    edits, i = 0, 0
    while i < len(following) and edits <= limit:
        edits, i = edits + 1, following[i]
    return edits


def within(x: str, y: str, limit: int) -> bool:
    """Whether the Levenshtein distance is at most `limit`: a column of the table at a time, its steps as bits of an integer."""
    start = 0
    short = min(len(x), len(y))
    while start < short and x[start] == y[start]:
        start += 1
    end = 0
    while end < short - start and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = x[start:len(x) - end], y[start:len(y) - end]
    if not x or not y:
        return max(len(x), len(y)) <= limit
    if abs(len(x) - len(y)) > limit:
        return False
    n, codes = len(x), _codes(x)
    where = {chr(int(c)): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score, rest = full, 0, n, len(y)
    for c in y:
        same = where.get(c, 0)
        diagonal = same | down
        flat = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(flat | up)), up & flat
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rest -= 1
        if score - rest > limit:
            return False
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
    return score <= limit


def near(x: Text, y: Text, limit: int) -> bool:
    for size in (4, 3):
        if least_edits(x, y, size, limit) > limit or least_edits(y, x, size, limit) > limit:
            return False
    return within(x.text, y.text, limit)


def _rows_before(n, k):
    """Rows of a string of n characters up to the place behind which grams are counted for the k-th time."""
    return ROWS * -(-(k + 1) * n // (16 * ROWS))


def _coded(texts: list[str], sizes: np.ndarray, code_of: np.ndarray) -> np.ndarray:
    """A row of codes for each text, 0 behind its end. The last of `code_of` is that of all further characters."""
    rows = np.zeros((len(texts), int(sizes.max())), code_of.dtype)
    for row, text in zip(rows, texts):
        row[:len(text)] = code_of[np.minimum(_codes(text), len(code_of) - 1)]
    return rows


def _may_be_near(x: np.ndarray, y: np.ndarray, of: np.ndarray, with_: np.ndarray, n: np.ndarray, m: np.ndarray,
                 limits: np.ndarray, bounds: np.ndarray, alphabet: int) -> np.ndarray:
    """Which pairs of rows `of` x and `with_` y, of n and m codes, may be within their limits; all that are stay.

    Edit distances of all pairs side by side, ROWS rows of the table at a time, its steps as bits of a word. Only cells
    that a path within the limits can pass are filled: a step outside costs one. A pair goes when each cell of the last row
    has taken more edits than the limit, with those that the rest takes for its length or its grams: `bounds` has, by the
    places behind which they are counted, those for its characters and its trigrams. What y has more of is not among them.
    """
    stay, more, limits = np.arange(len(n)), (m - n).astype(np.int32), limits.astype(np.int32)
    behind = _rows_before(n[:, None], np.arange(BEHIND))
    high = min(int(((limits + more) // 2).max()), int((limits - bounds[:, 0].max(1)).max()))
    one, full, last = np.uint64(1), np.uint64(2 ** 64 - 1), np.uint64(ROWS - 1)
    whose, own = np.unique(of, return_inverse=True)
    each, own = np.arange(len(whose)), own * alphabet
    least, done, start, end = int(n.min()), 0, 0, 0
    # By column and pair: places of the characters in the masks of a block, steps up and down of the row above it.
    at, rise, fall = np.empty((0, len(n)), np.intp), np.empty((0, len(n)), np.uint64), np.empty((0, len(n)), np.uint64)
    corner = np.zeros(len(n), np.int64)
    while done + ROWS <= least and len(stay) > FEW:
        to = max(min(y.shape[1], done + ROWS + high), start)
        if to > end:
            new = np.take(y[:, end:to], with_[stay], axis=0).T + own[stay]
            at = np.concatenate([at, new])
            rise = np.concatenate([rise, np.ones(new.shape, np.uint64)])
            fall = np.concatenate([fall, np.zeros(new.shape, np.uint64)])
            end = to
        where = np.zeros((len(whose), alphabet), np.uint64)
        for i in range(ROWS):
            where[each, x[whose, done + i]] |= one << np.uint64(i)
        where[:, 0] = 0
        where, width, count = where.reshape(-1), end - start, len(stay)
        up, down = np.full(count, full), np.zeros(count, np.uint64)
        same, vertical, level, higher = (np.empty(count, np.uint64) for _ in range(4))
        score = corner + ROWS
        steps, scores = [0], [score.astype(np.int32)]
        for j in range(width):
            above, under = rise[j], fall[j]
            np.take(where, at[j], out=same, mode="clip")
            np.bitwise_or(same, down, out=vertical)
            np.bitwise_or(same, under, out=same)
            np.bitwise_and(same, up, out=level)
            np.add(level, up, out=level)
            np.bitwise_xor(level, up, out=level)
            np.bitwise_or(level, same, out=level)
            np.bitwise_or(level, up, out=higher)
            np.invert(higher, out=higher)
            np.bitwise_or(higher, down, out=higher)
            np.bitwise_and(up, level, out=level)
            np.add(higher, higher, out=same)
            np.bitwise_or(same, above, out=same)
            np.add(level, level, out=down)
            np.bitwise_or(down, under, out=down)
            np.right_shift(higher, last, out=above)
            np.right_shift(level, last, out=under)
            np.bitwise_or(vertical, same, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, down, out=up)
            np.bitwise_and(same, vertical, out=down)
            np.add(score, above.view(np.int64), out=score)
            np.subtract(score, under.view(np.int64), out=score)
            if j % STRIDE == STRIDE - 1 or j == width - 1:
                steps.append(j + 1)
                scores.append(score.astype(np.int32))
        done += ROWS
        # Between the columns looked at a score differs by no more than the columns do.
        shift = np.array(steps, np.int32)[:, None] + np.int32(start - done)
        later = behind[stay] >= done
        rest = np.where(later.any(1)[:, None], bounds[stay, later.argmax(1)], 0)
        room, more_of = limits[stay] + np.int32(STRIDE) - np.stack(scores), more[stay] - shift
        far, more_of = np.abs(more_of) - np.int32(STRIDE), np.maximum(more_of - np.int32(STRIDE), 0)
        may = room >= np.maximum(far, np.maximum(rest[:, 0] + more_of, rest[:, 1] + more_of // 3))
        kept = may.any(0)
        if not kept.any():
            return stay[:0]
        # A step aside that leads away from the end takes another one back.
        reach = np.minimum(np.maximum(shift, more[stay]) + ((room - far) >> 1), shift + room - rest.max(1))
        high = min(high, int(np.where(may, reach, -len(y[0])).max()) + STRIDE)
        # No path comes back to columns before the first that one may pass.
        first = int(may.any(1).argmax())
        corner, skip = scores[first].astype(np.int64), steps[first]
        start, at, rise, fall = start + skip, at[skip:], rise[skip:], fall[skip:]
        if kept.sum() < 0.9 * count:
            stay, corner = stay[kept], corner[kept]
            at, rise, fall = (np.compress(kept, a, axis=1) for a in (at, rise, fall))
    return stay


def _compared(left: pd.DataFrame, right: pd.DataFrame, words: int, slack: float, short: int) -> pd.DataFrame:
    columns = ["md5"] + [f"s{i}" for i in range(words)]
    if left.empty or right.empty:
        return pd.DataFrame(columns=columns)
    texts, mine = right["chars"].tolist(), left["chars"].tolist()
    sizes, own = np.array([len(t) for t in texts]), np.array([len(t) for t in mine])
    held = np.stack([right[f"w{i}"].to_numpy(np.int64) for i in range(words)], 1)
    known = np.stack([left[f"w{i}"].to_numpy(np.int64) | left[f"c{i}"].to_numpy(np.int64) for i in range(words)], 1)
    before = known.copy()
    counts = [np.empty((len(texts), buckets), np.float32) for buckets in BUCKETS.values()]
    for k, t in enumerate(texts):
        for c, counted in zip(counts, _counts(_codes(t))):
            c[k] = counted
    ones = [np.ones(buckets, np.float32) for buckets in BUCKETS.values()]
    code_of = np.zeros(max(int(_codes(t).max()) for t in texts) + 2, bool)
    for t in texts:
        code_of[_codes(t)] = True
    code_of = np.where(code_of, np.cumsum(code_of), 0)
    alphabet = int(code_of.max()) + 1
    code_of = code_of.astype(np.uint16 if alphabet < 1 << 16 else np.int32)
    theirs, ours = _coded(texts, sizes, code_of), _coded(mine, own, code_of)
    text_of = cache(lambda k: Text(texts[k]))

    def open_pairs(of: np.ndarray, with_: np.ndarray) -> np.ndarray:
        return ((held[with_] & ~known[of]) != 0).any(1)

    def settle(of: np.ndarray, with_: np.ndarray, bounds: np.ndarray) -> None:
        """Looks at pairs, the likely ones first."""
        limits = np.floor(slack * np.maximum(own[of], sizes[with_]) + 1e-9).astype(int)
        # Those that leave room for few edits go together.
        room = limits - bounds[:, 0].max(1)
        tight, first = np.argsort(room, kind="stable"), 0
        while first < len(tight):
            part = tight[first:first + SIDE_BY_SIDE]
            filled = np.arange(1, len(part) + 1) * (ROWS + 2 * room[part])
            part = part[:max(int(np.searchsorted(filled, CELLS)), 2 * FEW)]
            first += len(part)
            part = part[open_pairs(of[part], with_[part])]
            if not len(part):
                continue
            part = part[_may_be_near(ours, theirs, of[part], with_[part], own[of[part]], sizes[with_[part]], limits[part], bounds[part], alphabet)]
            for k in np.sort(part):
                x, y = int(of[k]), int(with_[k])
                if ((held[y] & ~known[x]) != 0).any() and near(Text(mine[x]), text_of(y), int(limits[k])):
                    known[x] |= held[y]

    def flush(found: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        for part in (slice(0, FIRST), slice(FIRST, None)):
            of = np.concatenate([np.full(len(k[part]), i) for i, k, _ in found])
            if len(of):
                settle(of, np.concatenate([k[part] for _, k, _ in found]), np.concatenate([b[part] for _, _, b in found]))

    waiting, total = [], 0
    for i in np.argsort(own, kind="stable"):
        longest = np.maximum(sizes, own[i])
        limits = np.floor(slack * longest + 1e-9).astype(int)
        may = np.flatnonzero((np.abs(sizes - own[i]) <= limits) & ((held & ~known[i]) != 0).any(1) & (longest > short))
        if not len(may):
            continue
        codes = _codes(mine[i])
        for size, c, counted, one in zip(BUCKETS, counts, _counts(codes), ones):
            common = np.minimum(c[may], counted) @ one
            stay = common >= (longest - (size - 1) - size * limits)[may]
            may, common = may[stay], common[stay]
        if len(may):
            order = np.argsort(-common / longest[may], kind="stable")
            may = may[order]
            # Each edit of what is behind takes as many grams of it as they have characters, or fewer.
            bounds = np.zeros((len(may), BEHIND, 2), np.int32)
            for k in range(BEHIND):
                rest = codes[_rows_before(own[i], k):]
                for (size, c, counted, one), place in zip(zip(BUCKETS, counts, _counts(rest), ones), (0, None, 1)):
                    if place is not None:
                        missing = len(rest) - size + 1 - np.minimum(c[may], counted) @ one
                        bounds[:, k, place] = np.maximum(np.ceil(missing / size), 0)
            waiting.append((int(i), may, bounds))
            total += len(may)
        if total >= POOL:
            flush(waiting)
            waiting, total = [], 0
    if waiting:
        flush(waiting)
    new = known & ~before
    got = np.flatnonzero((new != 0).any(1))
    return pd.DataFrame([[left["md5"].iat[k], *new[k].tolist()] for k in got], columns=columns)
