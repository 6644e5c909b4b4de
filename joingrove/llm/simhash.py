"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A 64-bit fingerprint has eight bytes. Two fingerprints that differ in at most three bits differ in at
most three bytes, so at least five bytes are the same at their positions. A posting list per single
byte would hold a 256th of all fingerprints, hence lists are kept per triple of positions: each half
of four positions has four triples, and any five equal positions hold a whole triple of one half. Pairs
that meet in a list are tallied (how many positional bytes they share), kept from five on, and verified.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joingrove.llm.common import join_copies, join_hot, map_batches, stage, text_key, texts
from joingrove.llm.components import components
from joingrove.sources.staging import stage_observed

SHINGLE, SEED, RADIUS, BYTES = 3, 42, 3, 8
MIN_SHARED = BYTES - RADIUS
#: Positions of each posting list: the triples within either half.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: Fingerprints in a list up to which all its pairs are tallied. Longer lists are split by two more
#: positions, and what is still longer goes over shared variants; all three give the same components.
PAIR_LIMIT = 512
#: Shingles hashed at once.
CHUNK = 1 << 16


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed long; 0 without words.

    Words are what stands between ASCII white space after A-Z became lower case; a text with fewer
    words than a shingle is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(len(words) - SHINGLE + 1, 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):  # beside the words, memory does not grow with the text
        h = np.array([digest(b" ".join(words[j:j + SHINGLE]), SEED) for j in range(i, min(i + CHUNK, n))], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fp for each row; a null text counts as empty."""
    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, keys, bodies in batches:
            yield {"doc_id": ids, "text_key": keys, "fp": [fingerprint(t) for t in bodies]}

    rows = texts(docs, id_col, text_col).select("doc_id", text_key().alias("text_key"), "text")
    return map_batches(rows, run, "doc_id long, text_key long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- links between fingerprints

def _byte(fp: str, p: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 8 * p).bitwiseAND(F.lit(255))


def _mask(positions) -> int:
    m = sum(255 << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _postings(fps: DataFrame, lists: list[tuple[int, ...]], base: int = 0) -> DataFrame:
    """A row per fingerprint and list: the list's number, the bytes at its positions, the fingerprint."""
    rows = F.array(*[F.struct(F.lit(base + i).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("key"))
                     for i, t in enumerate(lists)])
    return fps.select("fp", F.explode(rows).alias("p")).select("p.list", "p.key", "fp")


def _sizes(postings: DataFrame) -> DataFrame:
    return postings.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def tallied(postings: DataFrame) -> DataFrame:
    """a, b, shared: pairs that meet in a list, with the number of positional bytes they share, from MIN_SHARED on.

    That is the least number two fingerprints within RADIUS bits share; pairs that only meet in their list's positions
    and one more go here, before the bits are looked at.
    """
    x, y = postings.select("list", "key", F.col("fp").alias("a")), postings.select("list", "key", F.col("fp").alias("b"))
    pairs = x.join(y, ["list", "key"]).where("a < b").select("a", "b", F.col("a").bitwiseXOR(F.col("b")).alias("fp"))
    shared = sum((F.when(_byte("fp", p) == 0, 1).otherwise(0) for p in range(BYTES)), F.lit(0))
    return pairs.select("a", "b", shared.alias("shared")).where(F.col("shared") >= MIN_SHARED).distinct()


def _verified(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")


def _by_variants(postings: DataFrame, lists: list[tuple[int, ...]]) -> DataFrame:
    """Links that join the same fingerprints as all pairs at distance RADIUS or less in long lists would.

    Within a list the bits outside its positions vary. Two members are at distance three or less if a
    fingerprint lies within one bit of one and two bits of the other. All members around it then link to
    the least of those within one bit, each at distance three or less: as many rows as variants, no pairs.
    """
    spark = postings.sparkSession
    masks = []
    for i, t in enumerate(lists):
        free = [b for p in range(BYTES) if p not in t for b in range(8 * p, 8 * p + 8)]
        for flips in range(3):
            for bits in combinations(free, flips):
                m = sum(1 << b for b in bits)
                masks.append((i, m - (1 << 64) if m >= 1 << 63 else m, flips))
    masks = spark.createDataFrame(masks, "list int, mask long, flips int")  # a few hundred rows a list
    around = (postings.join(F.broadcast(masks), "list")
              .select("list", "key", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", "flips"))
    centre = (around.where("flips <= 1").groupBy("list", "key", "variant")
              .agg(F.min("fp").alias("b")))
    return (around.join(centre, ["list", "key", "variant"]).where("fp != b")
            .select(F.col("fp").alias("a"), "b").distinct())


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """a, b: links that give distinct fingerprints `fp` their components; each link's ends differ by RADIUS bits or less.

    Lists of up to `pair_limit` fingerprints give all their links. Longer ones give all links of their
    lists by five positions; only lists that are still longer leave out links whose ends the others join.
    """
    def split(postings: DataFrame, label: str) -> tuple[DataFrame, DataFrame, int]:
        sizes, seen = stage_observed(_sizes(postings), label, F.sum(F.when(F.col("n") > pair_limit, 1).otherwise(0)).alias("long"))
        few = postings.join(sizes.where(F.col("n") <= pair_limit), ["list", "key"], "left_semi")
        many = postings.join(sizes.where(F.col("n") > pair_limit), ["list", "key"], "left_semi")
        return few, many, int(seen["long"] or 0)

    few, many, n = split(_postings(fps, TRIPLES), "simhash-lists")
    out = _verified(tallied(few))
    if n:
        fives = [t for t in combinations(range(BYTES), MIN_SHARED)]
        hot = stage(many.select("fp").distinct(), "simhash-long")
        few, many, n = split(_postings(hot, fives), "simhash-fives")
        out = out.unionByName(_verified(tallied(few)))
        if n:
            out = out.unionByName(_by_variants(many, fives))
    return out


# ---------------------------------------------------------------- documents

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """doc_id, text_key, fp, component_id for each row of `docs`.

    component_id is the smallest doc_id that links of RADIUS bits or less reach, its own included (null if
    all reached are null). Equal fingerprints are one node, so copies cost nothing beyond their count; a text without
    words, or null, has fingerprint 0. An empty table gives no rows.
    """
    rows, seen = stage_observed(fingerprints(docs, id_col, text_col), "simhash-docs", F.count(F.lit(1)).alias("n"))
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows")), "simhash-nodes")
    linked = components(links(nodes.select("fp"), pair_limit)).withColumnRenamed("node", "fp")
    rooted, found = stage_observed(nodes.join(linked, "fp", "left"), "simhash-roots", F.count("root").alias("linked"), F.max("n_rows").alias("most"))
    named = rooted.where("root is null").select("fp", "n_rows", F.col("least").alias("component_id"))
    if found["linked"]:
        inside = rooted.where("root is not null")
        groups, joined = stage_observed(inside.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")),
                                        "simhash-groups", F.sum("n").alias("n"), F.max("n").alias("most"))
        of_groups = join_copies(inside, groups.drop("n"), "root", groups, int(joined["n"] or 0), int(joined["most"] or 0))
        named = stage(named.unionByName(of_groups.select("fp", "n_rows", "component_id")), "simhash-named")
    return join_hot(rows, named, "fp", "n_rows", int(seen["n"] or 0), int(found["most"] or 0)) \
        .select("doc_id", "text_key", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are the first of their component, with all their columns.

    First is the smallest doc_id (a null one comes last), then the smallest hash of the text; of rows equal
    in both one stays. Columns of `docs` may have any names.
    """
    found = stage(near_duplicates(docs, id_col, text_col), "simhash-found")
    first = (found.groupBy(F.coalesce("component_id", F.col("fp")).alias("c"), F.col("component_id").isNull().alias("x"))
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")).alias("f"))
             .select("f.doc_id", "f.text_key").distinct())
    mine = lambda k: f"{k}_{uuid.uuid4().hex}"  # noqa: E731  a name that no column has
    an_id, a_key, keep_id, keep_key = map(mine, ("id", "key", "keep_id", "keep_key"))
    rows = docs.withColumns({an_id: F.col(id_col).cast("long"), a_key: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    first = first.toDF(keep_id, keep_key)
    kept = rows.join(first, F.col(an_id).eqNullSafe(F.col(keep_id)) & (F.col(a_key) == F.col(keep_key)), "left_semi")
    if not found.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([an_id, a_key])  # moves the texts again, so only where rows repeat
    return kept.drop(an_id, a_key)
