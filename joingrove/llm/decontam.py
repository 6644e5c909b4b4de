"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

A window of as many words as a benchmark item has is compared with it by the weighted sets of their five-word
shingles (weights are counts; fewer than five words are one shingle). A window that is similar enough has one of the
item's rarest shingles. Where such a shingle stands in a document, the window in which it has its place in the item is
fingerprinted by the SimHash of its shingles (equal windows once, in however many documents they stand), blocks of the
fingerprints find all items within a radius, and the weighted shingles of both verify them.

Any radius loses some pairs that are similar enough, and shingles may stand in another order. So what is left open
goes through a second search: the places of the item's shingles around the rare ones give the similarity of all
windows at once.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from joingrove.llm.common import join_hot, stage, text_key, texts
from joingrove.sources.staging import stage_observed

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 4, 15
BLOCK_BITS = BITS // BLOCKS
#: Bits flipped on the side of the windows and of the items; together RADIUS // BLOCKS.
WINDOW_FLIPS, ITEM_FLIPS = 1, 2
#: Rows up to which keys of documents and the shingles of the benchmark are broadcast (a few longs each).
KEYS = 500_000
WORD = r"[\p{L}\p{N}]+"
#: Letters of scripts that put no blanks between words: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3031-\u3035\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}]"


# ---------------------------------------------------------------- words, shingles, fingerprints

def words(text: Column) -> Column:
    """Runs of letters and digits in lower case: neither marks nor white space matter.

    Where a script has no blanks between words, each of its letters is a word, so a passage has the same words alone and
    inside a longer run.
    """
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), UNSPACED, " $0 "), F.lit(WORD), F.lit(0))


def _grams(hashes: str, size: int = SHINGLE) -> Column:
    """The hash of each shingle of `size` words of an array of word hashes, in order; empty for fewer words."""
    n = F.size(hashes) - (size - 1)
    at = F.slice(hashes, 1, F.greatest(n, F.lit(0)))
    return F.transform(at, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, size)]))


def _item_grams(hashes: str) -> Column:
    """As `_grams`; of fewer than SHINGLE words the one shingle of all of them."""
    return F.coalesce(*[F.when(F.size(hashes) == k, _grams(hashes, k)) for k in range(1, SHINGLE)], _grams(hashes))


def _hashed_words(rows: DataFrame, *keep: str) -> DataFrame:
    """`keep` and h, the hashes of the words of `text`."""
    return rows.select(*keep, words(F.col("text")).alias("w")).select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def _shingles(words_col: str) -> Column:
    """The shingles of an array of words, as text; fewer than SHINGLE words are one shingle."""
    n = F.greatest(F.size(words_col) - (SHINGLE - 1), F.least(F.size(words_col), F.lit(1)))
    return F.transform(F.slice(words_col, 1, n),
                       lambda x, i: F.array_join(F.slice(words_col, i + 1, SHINGLE), " "))


def _fingerprints(counted: DataFrame, key: str) -> DataFrame:
    """key, fp from rows of key, shingle, n: bit b is set if more than half of the weight has it.

    Two bits share one sum of a long, 32 bits of it each: more than an array has places for shingles.
    """
    spread, ones = F.lit(1 + (1 << 31)), F.lit(1 + (1 << 32))
    h = counted.select(key, "n", F.xxhash64("shingle").alias("h"))
    lanes = [F.sum((F.shiftrightunsigned("h", 2 * k).bitwiseAND(F.lit(3)) * spread).bitwiseAND(ones) * F.col("n")).alias(f"s{k}")
             for k in range(BITS // 2)]
    sums = h.groupBy(key).agg(F.sum("n").alias("n"), *lanes)
    bits = [F.when(F.shiftrightunsigned(f"s{b // 2}", 32 * (b % 2)).bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("n"),
                   F.lit(_signed(1 << b))).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    return sums.select(key, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _blocks(rows: DataFrame, key: str, flips: int) -> DataFrame:
    """A row per block and value within `flips` bits of it: key, fp, block, value."""
    masks = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(BLOCK_BITS), k)]
    values = F.array(*[F.struct(F.lit(i).alias("block"),
                                F.shiftrightunsigned("fp", i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("v"))
                       for i in range(BLOCKS)])
    return (rows.select(key, "fp", F.explode(values).alias("b"))
            .select(key, "fp", "b.block", "b.v", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
            .select(key, "fp", "block", F.col("v").bitwiseXOR(F.col("m")).alias("value")))


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """wid, item, distance: all pairs of fingerprints (wid, fp) and (item, fp) at RADIUS bits or less.

    At least one of BLOCKS blocks differs in at most RADIUS // BLOCKS bits, and those flips are split between the two
    sides.
    """
    a = _blocks(windows, "wid", WINDOW_FLIPS)
    b = _blocks(items, "item", ITEM_FLIPS).withColumnRenamed("fp", "item_fp")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    return (a.join(b, ["block", "value"]).select("wid", "item", distance.alias("distance"))
            .where(F.col("distance") <= RADIUS).distinct())


# ---------------------------------------------------------------- the search

def _counted(rows: DataFrame, key: str, words_col: str = "w") -> DataFrame:
    """key, shingle, n for rows of key and words."""
    return (rows.select(key, F.explode(_shingles(words_col)).alias("shingle"))
            .groupBy(key, "shingle").agg(F.count(F.lit(1)).alias("n")))


def _in_docs(rows: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """`keep`, at and gram: a row per shingle of each of `sizes` (words) of the word hashes h."""
    if sizes == [SHINGLE]:
        return rows.select(*keep, F.posexplode(_grams("h")).alias("at", "gram"))
    placed = [F.transform(_grams("h", k), lambda x, i: F.struct(i.alias("at"), x.alias("gram"))) for k in sizes]
    return rows.select(*keep, F.explode(F.concat(*placed)).alias("g")).select(*keep, "g.at", "g.gram")


def _rarest(item_grams: DataFrame, similarity: float) -> DataFrame:
    """gram, item, n, p: shingles of each item, rarest in the benchmark first, of which every window that is similar has
    one; n is the item's number of words, p the shingle's first place in it.

    A similar window shares at least `similarity` of the item's shingles, so it cannot miss more than the rest.
    """
    per_gram = item_grams.groupBy("gram").agg(F.sum("c").alias("everywhere"))
    before = F.sum("c").over(W.partitionBy("item").orderBy("everywhere", "gram").rowsBetween(W.unboundedPreceding, -1))
    missable = F.col("m") - F.ceil(F.col("m") * similarity - 1e-9)
    return (item_grams.join(per_gram, "gram").withColumn("before", F.coalesce(before, F.lit(0)))
            .where(F.col("before") <= missable).select("gram", "item", "n", "p"))


def _best_windows(hits: DataFrame, similarity: float) -> DataFrame:
    """doc_id, key, item, n, start, similarity: the best window of each document and item, where similar enough.

    `hits` has a row per place in a document of a shingle of a candidate item: doc_id, key, of (words of the document),
    item, n (words), m (shingles), gram, c (how often the item has it), at. A place counts in the windows that hold it
    and not the c-th place of its shingle before it, which is one run of window starts; the sum of the runs
    over a start is the weight that its window shares with the item.
    """
    pair = ["doc_id", "key", "item"]
    last, shape = F.greatest(F.col("of") - F.col("n"), F.lit(0)), ["of", "n", "m"]
    run = lambda p, i: F.struct(
        F.greatest(F.coalesce(F.get("places", (i - F.col("c")).cast("int")), F.lit(-1)) + 1, p - F.col("m") + 1, F.lit(0)).alias("first"),
        F.least(p, last).alias("last"))
    runs = (hits.groupBy(*pair, *shape, "gram", "c").agg(F.sort_array(F.collect_set("at")).alias("places"))
            .select(*pair, *shape, F.explode(F.transform("places", run)).alias("r")).where("r.first <= r.last"))
    steps = runs.select(*pair, *shape, F.explode(F.array(
        F.struct(F.col("r.first").alias("start"), F.lit(1).alias("step")),
        F.struct((F.col("r.last") + 1).alias("start"), F.lit(-1).alias("step")))).alias("s"))
    shared = F.sum("step").over(W.partitionBy(*pair).orderBy("start"))
    best = (steps.groupBy(*pair, *shape, "s.start").agg(F.sum("s.step").alias("step")).withColumn("common", shared)
            .groupBy(*pair, *shape).agg(F.max(F.struct("common", (-F.col("start")).alias("back"))).alias("b")))
    own = F.col("m") - F.greatest(F.col("n") - F.col("of"), F.lit(0))  # shingles of the window
    return (best.withColumn("similarity", F.col("b.common") / (own + F.col("m") - F.col("b.common")))
            .where(F.col("similarity") >= similarity)
            .select(*pair, "n", (-F.col("b.back")).alias("start"), "similarity"))


def _no_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(_signed(1 << 63)))


def _set_bits(mask: int | None) -> list[int]:
    return [k for k in range(64) if (mask or 0) >> k & 1]


def _cell_class(n: str) -> Column:
    """The least c with 2 ** c at or above n."""
    return F.length(F.bin(F.col(n).cast("long") - 1))


def _cut(near: DataFrame, spans: DataFrame, label: str) -> tuple[DataFrame, int]:
    """d, key, start, n, wid and the words w of windows (d, key, start, n) of the texts `near`, and their number."""
    spans = spans.groupBy("d", "key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    cut = (near.join(spans, ["d", "key"]).select("d", "key", F.explode(F.transform("spans", lambda s: F.struct(
               s["start"].alias("start"), s["n"].alias("n"), F.slice("w", s["start"].cast("int") + 1, s["n"]).alias("w")))).alias("s"))
           .select("d", "key", "s.start", "s.n", "s.w", F.xxhash64("s.w").alias("wid")))
    windows, total = stage_observed(cut, label, F.count(F.lit(1)).alias("rows"))
    return windows, int(total["rows"] or 0)


def _verified(windows: DataFrame, items: DataFrame, item_counts: DataFrame, item_prints: DataFrame, similarity: float) -> DataFrame:
    """wid, item, n, distance, similarity: windows within the radius of an item of their size that are similar enough.

    Equal windows are one, in however many documents they stand.
    """
    distinct = windows.groupBy("wid").agg(F.first("w").alias("w"))
    counted = stage(_counted(distinct, "wid"), "leak-counted")
    prints = stage(_fingerprints(counted, "wid"), "leak-prints")
    sized = windows.select("wid", "n").distinct()
    pairs = (within_radius(prints, item_prints).join(items.select("item", F.size("w").alias("n")), "item")
             .join(sized, ["wid", "n"]))
    pairs = stage(pairs, "leak-close")
    mine = counted.groupBy("wid").agg(F.sum("n").alias("own"))
    theirs = item_counts.groupBy("item").agg(F.sum("n").alias("all"))
    common = (pairs.select("wid", "item").join(counted, "wid").join(item_counts.withColumnRenamed("n", "c"), ["item", "shingle"])
              .groupBy("wid", "item").agg(F.sum(F.least("n", "c")).alias("common")))
    return (pairs.join(common, ["wid", "item"]).join(mine, "wid").join(theirs, "item")
            .withColumn("similarity", F.col("common") / (F.col("own") + F.col("all") - F.col("common")))
            .where(F.col("similarity") >= similarity).select("wid", "item", "n", "distance", "similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key, item_id, start_word, n_words, distance, similarity, by_blocks: a window for each document and item it holds.

    A row stands for a window of the item's number of words (or the whole document, if shorter) whose
    shingles are similar enough. With `by_blocks` it is, of the windows on which one of the item's rarest shingles stands in
    its place and whose fingerprints lie within RADIUS bits, the most similar, then the earliest. Else none of those is
    similar enough, and it is the most similar, then the earliest, of all windows of that size. distance is that of the
    fingerprints, in bits. An item of fewer than five words has one shingle, so it is found where all its words
    stand in its order. Null or empty texts, items without words and null item ids give nothing; items with equal
    ids are one row each by their text; rows repeated in id and text count once.
    """
    items = (benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(item_text_col, F.lit("")).alias("text"))
             .where("item_id is not null").withColumn("item", F.xxhash64("item_id", "text")).distinct())
    items, known = stage_observed(items.select("item_id", "item", words(F.col("text")).alias("w")).where(F.size("w") > 0),
                                  "leak-items", F.count(F.lit(1)).alias("rows"), F.expr(f"bit_or(shiftleft(1, least(size(w), {SHINGLE})))").alias("sizes"))
    hashed = items.select("item", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    m = F.col("n") - F.least(F.col("n"), F.lit(SHINGLE)) + 1
    grams = (hashed.select("item", "n", F.posexplode(_item_grams("h")).alias("p", "gram"))
             .groupBy("item", "n", "gram").agg(F.count(F.lit(1)).alias("c"), F.min("p").alias("p")).withColumn("m", m))
    grams, seen = stage_observed(grams, "leak-grams", F.count(F.lit(1)).alias("rows"))
    sizes = _set_bits(known["sizes"]) or [SHINGLE]  # at most five
    small = lambda d, rows: F.broadcast(d) if int(rows or 0) <= KEYS else d

    # Where the rarest shingles of items stand in documents.
    rows = texts(docs, id_col, text_col).select(_no_null(F.col("doc_id")).alias("d"), text_key().alias("key"), "text")
    rare = stage(_rarest(grams, similarity), "leak-rarest")
    hashes = _hashed_words(rows, "d", "key").select("d", "key", "h", F.size("h").alias("of"))
    # They are few, so tasks write them together, not each a file of its own; those of repeated rows are one.
    hits = stage(_in_docs(hashes, sizes, "d", "key", "of").join(small(rare, seen["rows"]), "gram")
                 .select("d", "key", "of", "item", "n", "at", "p").distinct(), "leak-hits")
    holders, found = stage_observed(hits.select("d", "key").distinct(), "leak-holders", F.count(F.lit(1)).alias("rows"))
    near = rows.join(small(holders, found["rows"]), ["d", "key"]).groupBy("d", "key").agg(F.min("text").alias("text"))
    near = stage(near.select("d", "key", words(F.col("text")).alias("w")), "leak-texts")

    # The windows that these shingles point at: close by their fingerprints, then by their shingles.
    last = F.greatest(F.col("of") - F.col("n"), F.lit(0))
    start = F.greatest(F.least(F.col("at") - F.col("p"), last), F.lit(0)).cast("long")
    windows, total = _cut(near, hits.select("d", "key", start.alias("start"), "n").distinct(), "leak-windows")
    item_counts = stage(_counted(items.select("item", "w"), "item"), "leak-item-counts")
    item_prints = stage(_fingerprints(item_counts, "item"), "leak-item-prints")
    verified = _verified(windows, items, item_counts, item_prints, similarity)
    times = windows.groupBy("wid", "n").agg(F.count(F.lit(1)).alias("n_rows"))
    per_window = (verified.join(times, ["wid", "n"]).groupBy("wid", "n", "n_rows")
                  .agg(F.collect_list(F.struct("item", "distance", "similarity")).alias("of_items"))
                  .withColumn("pair", F.xxhash64("wid", "n")).drop("wid", "n"))
    at = windows.select("d", "key", "start", F.size("w").alias("n_words"), F.xxhash64("wid", "n").alias("pair"))
    per_window, times = stage_observed(per_window, "leak-verified", F.max("n_rows").alias("most"))
    by_blocks = (join_hot(at, per_window, "pair", "n_rows", total, int(times["most"] or 0))
                 .select("d", "key", "start", "n_words", F.explode("of_items").alias("f")).groupBy("d", "key", "f.item")
                 .agg(F.max(F.struct("f.similarity", (-F.col("start")).alias("back"), "n_words", "f.distance")).alias("b"))
                 .select("d", "key", "item", (-F.col("b.back")).alias("start_word"), "b.n_words", "b.distance", "b.similarity",
                         F.lit(True).alias("by_blocks")))
    by_blocks = stage(by_blocks, "leak-by-blocks")

    # What no radius reaches: the similarity of all windows, where a document's rare shingles left the pair open.
    # Where no place or no similar window is left, nothing more is planned or run.
    open_hits = hits.join(by_blocks.select("d", "key", "item"), ["d", "key", "item"], "left_anti")
    cell = F.floor(F.col("at") / F.pow(F.lit(2), F.col("kind"))).cast("long")
    cells = (open_hits.withColumn("kind", _cell_class("n")).select("d", "key", "of", "item", "kind", cell.alias("cell"))
             .withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).distinct())
    cells, left = stage_observed(cells, "leak-cells", F.count(F.lit(1)).alias("rows"), F.expr("bit_or(shiftleft(1L, kind))").alias("kinds"))
    out = by_blocks
    if left["rows"]:
        places = _in_docs(near.select("d", "key", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
                          .join(small(cells.select("d", "key").distinct(), left["rows"]), ["d", "key"], "left_semi"), sizes, "d", "key")
        places = places.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in _set_bits(left["kinds"])]))).withColumn("cell", cell)
        shared = (places.join(cells, ["d", "key", "kind", "cell"]).join(small(grams, seen["rows"]), ["item", "gram"])
                  .select(F.col("d").alias("doc_id"), "key", "of", "item", "n", "m", "gram", "c", "at"))
        best, more = stage_observed(_best_windows(shared, similarity).withColumnRenamed("doc_id", "d"), "leak-best", F.count(F.lit(1)).alias("rows"))
        if more["rows"]:
            windows, total = _cut(near, best.select("d", "key", F.col("start").cast("long").alias("start"), "n"), "leak-other-windows")
            prints = _fingerprints(_counted(windows.groupBy("wid").agg(F.first("w").alias("w")), "wid"), "wid")
            prints, times = stage_observed(windows.groupBy("wid").agg(F.count(F.lit(1)).alias("n_rows")).join(prints, "wid"), "leak-other-prints", F.max("n_rows").alias("most"))
            printed = join_hot(windows.select("d", "key", "start", "n", F.size("w").alias("n_words"), "wid"), prints, "wid", "n_rows", total, int(times["most"] or 0))
            others = (best.withColumn("start", F.col("start").cast("long")).join(printed, ["d", "key", "start", "n"])
                      .join(small(item_prints.withColumnRenamed("fp", "item_fp"), known["rows"]), "item")
                      .select("d", "key", "item", F.col("start").alias("start_word"), "n_words",
                              F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance"), "similarity", F.lit(False).alias("by_blocks")))
            out = out.unionByName(others)
    named = items.select("item", "item_id")
    return (out.join(small(named, known["rows"]), "item")
            .select(F.when(F.col("d") != F.lit(_signed(1 << 63)), F.col("d")).alias("doc_id"), "key", "item_id", F.col("start_word").cast("long").alias("start_word"),
                    F.col("n_words").cast("long").alias("n_words"), F.col("distance").cast("int").alias("distance"), "similarity", "by_blocks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, in which no item of the benchmark was found.

    Rows with null or empty texts stay, repeated rows stay or go together, an empty benchmark leaves all rows.
    """
    found = stage(leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_leak_id"), F.col("key").alias("_leak_key")).distinct(), "leaks")
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["_leak_id"]) & (own == found["_leak_key"]), "left_anti")
