"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

For an ordinary MinHash every element draws a rank for every place of the signature. Here an element draws one random
permutation of the places and gives the place at its j-th step the value j + r with a random r below 1: all places
of one element differ in rank, so estimates vary less, and a place that some element has reached at step j cannot
be improved by a later step. All elements therefore take their steps together, and a text is done as soon as each place
has a value, after one to three steps unless it is short.

Equal sets are one node. Texts whose signatures agree in a band of four places meet in a bucket. A bucket of any size
is searched from pivots: each member is compared with the pivot, and the distance to it (Jaccard distance is a metric)
together with the components found so far tells which members need comparing any further, and these are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joingrove.llm.common import join_copies, map_batches, stage, text_key, texts
from joingrove.llm.components import components
from joingrove.sources.staging import stage_observed

PLACES, BAND = 128, 4
BANDS = PLACES // BAND
#: Linked are sets with 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Equal places (of 128) below which sets of similarity 0.8 are six standard deviations away, and below which sets of
#: similarity 0.6 are five: these are too far from a pivot to be linked with anything that is linked with it.
CLOSE, FAR = 76, 49
#: Members up to which a bucket is settled by comparing all of them, and members with their sets in a task's block.
SMALL, BLOCK = 32, 1024
#: Keys (24 bytes each) up to which the texts to be read again are named by broadcast.
KEYS = 500_000
#: Shingles that take their steps together, and words whose hashes a task remembers.
TOGETHER, REMEMBERED = 1 << 16, 1 << 17

_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ---------------------------------------------------------------- shingles and signatures

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The sets of distinct 2-word shingles of texts, as sorted 64-bit hashes."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Words stand between ASCII white space after A-Z became lower case; one word alone is a shingle."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) == 1:
            return _mixed(h + _A)
        return np.unique(_mixed(_mixed(h[:-1] + _GOLD) + h[1:]))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (texts, PLACES) of sets that are not empty, each place as a 16-bit hash of its value."""
    n = len(sets)
    if not n:
        return np.empty((0, PLACES), np.uint16)
    of, h = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    out, filled, order = np.zeros(n * PLACES, np.uint16), np.zeros(n * PLACES, bool), None
    for step in range(PLACES):
        u = _mixed(h + np.uint64((step + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        at = step + ((u >> np.uint64(40)) * np.uint64(PLACES - step) >> np.uint64(24)).astype(np.int64)
        if order is None:
            place = at
        else:  # the permutation's next place comes from a swap
            own = np.arange(len(at))
            place = order[own, at].astype(np.int64)
            order[own, at] = order[own, step]
        slot = of * PLACES + place
        open_ = ~filled[slot]
        slot, r = slot[open_], (u[open_] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        least = np.full(n * PLACES, 0xFFFFFFFF, np.uint32)
        np.minimum.at(least, slot, r)
        new = np.unique(slot)
        out[new] = (_mixed(least[new].astype(np.uint64) + np.uint64(step << 32)) >> np.uint64(48)).astype(np.uint16)
        filled[new] = True
        go = ~filled.reshape(n, PLACES).all(1)[of]
        if not go.any():
            break
        if order is None:
            swapped = at[go]
            order = np.tile(np.arange(PLACES, dtype=np.uint8), (len(swapped), 1))
            order[np.arange(len(swapped)), swapped] = 0
        elif not go.all():
            order = order[go]
        of, h = of[go], h[go]
    return out.reshape(n, PLACES)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, node, bands: a row per row of `docs`; node, a hash of the set, is null for an empty one."""
    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        shingles = Shingler()
        for ids, keys, bodies in batches:
            start = 0
            while start < len(ids):
                sets, size = [], 0
                while start + len(sets) < len(ids) and size < TOGETHER:
                    sets.append(shingles(bodies[start + len(sets)]))
                    size += len(sets[-1])
                end = start + len(sets)
                signed = iter(signatures([s for s in sets if len(s)]).view("<i8").tolist())
                yield {"doc_id": ids[start:end], "key": keys[start:end], "n_shingles": [len(s) for s in sets],
                       "node": [int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True) if len(s) else None for s in sets],
                       "bands": [next(signed) if len(s) else None for s in sets]}
                start = end

    rows = texts(docs, id_col, text_col).select("doc_id", text_key().alias("key"), "text")
    return map_batches(rows, run, "doc_id long, key long, n_shingles long, node long, bands array<bigint>")


def _sets(docs: DataFrame, needed: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """node, grams: the sets of the nodes `needed` (node, doc_id, key), from their texts."""
    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        shingles = Shingler()
        for nodes, bodies in batches:
            for i in range(0, len(nodes), 64):
                yield {"node": nodes[i:i + 64], "grams": [shingles(t).view(np.int64).tolist() for t in bodies[i:i + 64]]}

    rows = texts(docs, id_col, text_col).withColumn("key", text_key())
    named = needed.select(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key"), "node")  # `n` of them at most
    same = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key"))
    found = rows.join(F.broadcast(named) if n <= KEYS else named, same).select("node", "text")
    return map_batches(found, run, "node long, grams array<bigint>").dropDuplicates(["node"])


# ---------------------------------------------------------------- links

def _equal_places(a: str, b: str) -> Column:
    lanes = lambda x: sum(((F.shiftrightunsigned(x, s).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int") for s in (16, 32, 48)),
                          (x.bitwiseAND(F.lit(0xFFFF)) == 0).cast("int"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: lanes(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _degrees(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))


def _compared(pairs: DataFrame, total: int, nodes: DataFrame) -> DataFrame:
    """The pairs (node, pivot) with `places`, how many places of their signatures are equal, and `close`: whether these and
    the sizes of the sets leave a link possible."""
    mine = nodes.select("node", "bands", "n_shingles")
    theirs = nodes.select(F.col("node").alias("pivot"), F.col("bands").alias("p_bands"), F.col("n_shingles").alias("p_n"))
    both = join_copies(pairs, theirs, "pivot", _degrees(pairs), total).join(mine, "node")
    places = both.select("node", "pivot", _equal_places("bands", "p_bands").alias("places"), "n_shingles", "p_n")
    like_size = 100 * F.least("n_shingles", "p_n") >= PERCENT * F.greatest("n_shingles", "p_n")
    return places.select("node", "pivot", "places", ((F.col("places") >= CLOSE) & like_size).alias("close"))


class _Links:
    """The links found so far, and the search among further pairs."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> None:
        self.docs, self.nodes, self.columns, self.found = docs, nodes, (id_col, text_col), []

    def among(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs (node, pivot) with `places`, staged, and `linked` where 100 * intersection >= PERCENT * union."""
        pairs, seen = stage_observed(pairs.select("node", "pivot").distinct(), "minhash-pairs", F.count(F.lit(1)).alias("n"))
        compared, seen = stage_observed(_compared(pairs, int(seen["n"] or 0), self.nodes), "minhash-compared",
                                        F.sum(F.col("close").cast("long")).alias("n"))
        n = int(seen["n"] or 0)
        if not n:
            return compared.withColumn("linked", F.lit(False))
        close = compared.where("close").select("node", "pivot")
        sets = self.sets(close.select(F.explode(F.array("node", "pivot")).alias("node")).distinct(), 2 * n)
        pivots = sets.select(F.col("node").alias("pivot"), F.col("grams").alias("p_grams"))
        both = join_copies(close.join(sets, "node"), pivots.join(close.select("pivot").distinct(), "pivot", "left_semi"), "pivot", _degrees(close), n)
        common = F.size(F.array_intersect("grams", "p_grams"))
        union = F.size("grams") + F.size("p_grams") - common
        self.found.append(stage(both.where(100 * common >= PERCENT * union).select("node", "pivot"), "minhash-links"))
        return (compared.join(self.found[-1].withColumn("linked", F.lit(True)), ["node", "pivot"], "left")
                .withColumn("linked", F.coalesce("linked", F.lit(False))))

    def sets(self, wanted: DataFrame, n: int) -> DataFrame:
        """node, grams of at most `n` nodes, staged."""
        return stage(_sets(self.docs, wanted.join(self.nodes.select("node", "doc_id", "key"), "node"), n, *self.columns), "minhash-sets")

    def all(self) -> DataFrame | None:
        return _union(self.found) if self.found else None

    def roots(self) -> DataFrame:
        return components(_union(self.found), "node", "pivot")


def _small_pairs(parts: DataFrame, few: DataFrame, total: int) -> DataFrame:
    """All pairs (node, pivot) of members of a bucket of at most SMALL but those that a pivot has linked."""
    rows = join_copies(parts.drop("band"), few, "bucket", few, total)
    other = rows.select("bucket", F.col("node").alias("pivot"), F.col("linked").alias("p_linked"))
    return rows.join(other, "bucket").where("node < pivot AND NOT (linked AND p_linked)")


LARGE = "node long, pivot long"


def _large_buckets(rows: DataFrame, nodes: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """node, pivot: links between members of a bucket in different components, one of them outside the main one.

    `rows` has bucket, band, node, root, and its bucket's main component and number of blocks. Members with their sets are dealt
    to these blocks, and a task compares two blocks: signatures first, then sets, in numpy. A pair is looked at in the first
    band that it shares, and not at all once links of this task join its components. A node meets its set once and then
    goes to all its buckets, at most two for each band.
    """
    homes = rows.groupBy("node", "root").agg(F.collect_list(F.struct("bucket", "band", "main", "blocks")).alias("homes"))
    full = homes.join(nodes.select("node", "bands"), "node").join(sets, "node")
    each = full.select("node", "root", "bands", "grams", F.explode("homes").alias("at")).select("at.*", "node", "root", "bands", "grams")
    own, every = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    right, left = F.transform(every, lambda i: cell(i, own, 1)), F.transform(every, lambda j: cell(own, j, 0))
    cells = F.explode(F.when(F.col("root") != F.col("main"), F.concat(right, left)).otherwise(right)).alias("cell")
    dealt = (each.select("bucket", cells, "band", "node", "root", "bands", "grams")
             .select("bucket", "cell.*", "band", "node", "root", "bands", "grams")
             .repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side"))
    return map_batches(dealt, _compare_blocks, LARGE)


def _compare_blocks(batches: Iterator[tuple]) -> Iterator[dict]:
    here, left, root_of, found = None, None, {}, []

    def top(root: int) -> int:
        while root_of.get(root, root) != root:
            root = root_of[root]
        return root

    for columns in batches:
        for bucket, i, j, side, band, node, root, bands, grams in zip(*columns):
            if here != (bucket, i, j):
                here, left = (bucket, i, j), ([], [], [], [])
            sorted_ = np.sort(np.array(grams, np.int64))
            if side == 0:
                for part, x in zip(left, (node, root, bands, sorted_)):
                    part.append(x)
                continue
            if not left[0]:
                continue
            if isinstance(left[2], list):
                left = (left[0], left[1], np.array(left[2], "<i8"), left[3])
            mine = np.array(bands, "<i8")
            places = (left[2].view(np.uint16) == mine.view(np.uint16)).sum(1)
            first = (left[2] == mine).argmax(1)
            for k in np.flatnonzero((places >= CLOSE) & (first == band)):
                a, b = top(left[1][k]), top(root)
                if a == b:
                    continue
                other = left[3][k]
                at = np.searchsorted(other, sorted_)
                common = int((other[np.minimum(at, len(other) - 1)] == sorted_).sum())
                if 100 * common >= PERCENT * (len(other) + len(sorted_) - common):
                    root_of[max(a, b)] = min(a, b)
                    found.append((left[0][k], node))
        if found:
            yield {"node": [f[0] for f in found], "pivot": [f[1] for f in found]}
            found = []


def links(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame | None:
    """node, pivot: links that give the sets their components; None without any.

    `nodes` (staged) has node, bands, n_shingles, and doc_id and key of a row that holds the set. The members of each
    bucket are compared with its pivot. Members too far from the pivot cannot be linked with those linked with it, so
    the bucket falls into those near it, as long as some of them are not linked with it, and those not linked with it.
    What has at most `small` members is settled by all its pairs. Of what has more, the members outside the component that
    most belong to are compared with all others within tasks, block by block.
    """
    links_of = _Links(docs, nodes, id_col, text_col)
    active = nodes.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "band", "node")
    heads, seen = stage_observed(active.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1"),
                                 "minhash-heads", F.sum("n").alias("rows"), F.max("n").alias("largest"))
    if not seen["rows"]:
        return None
    members = stage(join_copies(active, heads.select("bucket", "pivot"), "bucket", heads, int(seen["rows"])).where("node != pivot"), "minhash-members")
    compared = links_of.among(members)
    if seen["largest"] <= 2:
        return links_of.all()
    rest = members.join(compared.select("node", "pivot", (F.col("places") >= FAR).alias("near"), "linked"), ["node", "pivot"])
    side = lambda k: F.xxhash64("bucket", F.lit(k)).alias("bucket")
    parts = stage(rest.where("near").select(side(1), "band", "node", "linked")
                  .unionByName(rest.where("NOT linked").select(side(2), "band", "node", "linked")), "minhash-parts")
    done = F.col("linked").cast("long")
    groups, still = stage_observed(
        parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(done).alias("done"), F.min(F.when(F.col("linked"), F.col("node"))).alias("one"))
        .where("n > 1 AND done < n"), "minhash-groups", F.sum(F.when(F.col("n") <= small, F.col("n"))).alias("few"),
        F.sum(F.when(F.col("n") > small, F.col("n") - F.col("done"))).alias("apart"))
    if still["few"]:
        few = groups.where(F.col("n") <= small).select("bucket", "n")
        links_of.among(_small_pairs(parts, few, int(still["few"])))
    if not still["apart"]:
        return links_of.all()

    # Members linked with the pivot are in one component, which one of them tells: only the others are looked up.
    large = groups.where(F.col("n") > small).withColumn("n", F.col("n") - F.col("done"))
    apart = join_copies(parts.where("NOT linked").select("bucket", "node"), large.select("bucket"), "bucket", large, int(still["apart"]))
    told = apart.withColumn("n", F.lit(1)).unionByName(large.where("done > 0").select("bucket", F.col("one").alias("node"), F.col("done").alias("n")))
    roots = stage(links_of.roots(), "minhash-rooted") if links_of.found else None

    def rooted(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    most = (rooted(told).groupBy("bucket", "root").agg(F.sum("n").alias("n"))
            .groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("m")))
    open_, left = stage_observed(most.where("m.n < n").select("bucket", "n", F.col("m.root").alias("main")), "minhash-open", F.sum("n").alias("n"))
    if left["n"]:
        total = int(left["n"])
        blocks = open_.select("bucket", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        rows = stage(rooted(join_copies(parts.select("bucket", "band", "node"), blocks, "bucket", open_, total)), "minhash-rest")
        sets = links_of.sets(rows.select("node").distinct(), total)
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        links_of.found.append(stage(_large_buckets(rows, nodes, sets, parts), "minhash-links"))
    return links_of.all()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- documents

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`.

    component_id is the smallest doc_id that links reach, the row's own included; a text without words is linked with
    nothing. Null ids are never the smallest, so component_id is null where all reached are null. kept says whether
    doc_id is component_id. Rows that repeat, and others with equal sets, are one node however many they are. A null text
    is empty; an empty table gives no rows. A set is known by a 64-bit hash of its shingles' 64-bit hashes.
    """
    rows, seen = stage_observed(sketches(docs, id_col, text_col), "minhash-docs", F.count("node").alias("n"))
    total = int(seen["n"] or 0)
    holder = F.min(F.struct("doc_id", "key"))
    nodes = stage(rows.where("node IS NOT NULL").groupBy("node")
                  .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"), F.min("n_shingles").alias("n_shingles"),
                       F.min("bands").alias("bands"), holder.alias("h"))
                  .select("node", "least", "n_rows", "n_shingles", "bands", "h.doc_id", "h.key"), "minhash-nodes")
    found = links(docs, nodes, id_col, text_col, small)
    least = nodes.select("node", "least", "n_rows")
    if found is not None:
        rooted = stage(least.join(components(found, "node", "pivot"), "node", "left"), "minhash-rooted")
        inside = rooted.where("root IS NOT NULL")
        groups, joined = stage_observed(inside.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n")),
                                        "minhash-groups", F.sum("n").alias("n"))
        inside = join_copies(inside, groups.drop("n"), "root", groups, int(joined["n"] or 0))
        alone = rooted.where("root IS NULL").select("node", "n_rows", F.col("least").alias("component_id"))
        least = stage(alone.unionByName(inside.select("node", "n_rows", F.col("first").alias("component_id"))), "minhash-named")
    else:
        least = least.withColumnRenamed("least", "component_id")
    named = join_copies(rows.where("node IS NOT NULL").select("doc_id", "n_shingles", "node"), least.drop("n_rows"), "node",
                        least.withColumnRenamed("n_rows", "n"), total)
    empty = rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (named.select("doc_id", "n_shingles", "component_id").unionByName(empty)
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
