"""Finding joinable columns.

All column pairs of all tables are scored in one job: each table is read once,
each distinct value becomes one row with the set of columns that hold it, and
pairs are only formed from the distinct column sets, whose number depends on
the schema and hardly on the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from joingrove.functions.naming import quote
from joingrove.functions.types import BOOLEAN, FRACTIONAL, INTEGRAL, STRING, TIMESTAMP, number_sql
from joingrove.operators.edges import above, both_directions
from joingrove.operators.long_values import near_long_columns
from joingrove.sources.catalog import Catalog
from joingrove.sources.staging import stage, stage_observed

# Strings longer than this meet by their digest, which is longer still; near
# ones of them are found by their grams, not by segments.
LONG_VALUE = 64
WORD = 63

# The weights of the composite score and the least similarity of
# two values that count as near-equal.
SCHEMA_WEIGHTS = {"name": 0.875, "type": 0.125, "inst": 0.0}
INSTANCE_WEIGHTS = {"name": 0.7, "type": 0.1, "inst": 0.2}
NEAR = 0.8

# Column sets up to which their masks are broadcast.
MAX_SETS = 100_000

# Values in the first slice of those that open ones are compared with, and how
# much larger each further slice is.
FIRST_SLICE, SLICE_GROWTH = 256, 8


# -- pairs of columns --------------------------------------------------------


def table_pairs(columns: DataFrame) -> DataFrame:
    """Unordered pairs of tables (B1): rows of schema, not of data."""
    tables = columns.select("table").distinct()
    first, second = tables.withColumnRenamed("table", "table1"), tables.withColumnRenamed("table", "table2")
    return first.join(second, F.col("table1") < F.col("table2"))


def column_pairs(columns: DataFrame) -> DataFrame:
    """All pairs of columns of two different tables, the first table first by name."""
    first = columns.select(F.col("table").alias("table1"), F.struct("*").alias("c1"))
    second = columns.select(F.col("table").alias("table2"), F.struct("*").alias("c2"))
    return table_pairs(columns).join(first, "table1").join(second, "table2").select("c1", "c2")


# -- shared values -----------------------------------------------------------


def _value_sql(name: str, kind: str, dtype, whole: bool = False) -> str:
    """A value in a form that is equal for equal values of a family."""
    col = quote(name)
    if kind == INTEGRAL:
        return f"cast({col} AS bigint)"
    if kind == BOOLEAN:
        return f"cast(cast({col} AS int) AS bigint)"
    if kind == TIMESTAMP:
        return f"cast(round({number_sql(name, dtype)} * 1e6D) AS bigint)"
    if kind == FRACTIONAL:
        return number_sql(name, dtype)
    if whole:
        return col
    return f"CASE WHEN length({col}) > {LONG_VALUE} THEN concat('sha256:', sha2({col}, 256)) ELSE {col} END"


def column_values(catalog: Catalog, whole: bool = False) -> tuple[dict[str, DataFrame], int]:
    """Per type family (value, w0, w1, ...): every distinct value with the
    bitmap of the columns that hold it; and the number of bitmap words. Long
    strings are given by a digest unless `whole`.

    The bitmaps are merged before the shuffle, so a value that fills a column
    leaves a task once.
    """
    columns = catalog.column_list()
    words = max(1, -(-len(columns) // WORD))
    bits = [f"bit_or(CASE WHEN id DIV {WORD} = {w} THEN shiftleft(1L, id % {WORD}) ELSE 0L END) AS w{w}"
            for w in range(words)] if words > 1 else ["bit_or(shiftleft(1L, id)) AS w0"]
    values = {}
    for kind in sorted({c[3] for c in columns}):
        parts = []
        for table in catalog.names:
            mine = [(i, name) for i, t, name, k in columns if t == table and k == kind]
            if not mine:
                continue
            schema = catalog.schema(table)
            wide = catalog.table(table).selectExpr(*[
                f"{_value_sql(name, kind, schema[name].dataType, whole)} AS `{i}`" for i, name in mine])
            parts.append(wide.unpivot([], [f"`{i}`" for i, _ in mine], "id", "value"))
        long = reduce(DataFrame.unionByName, parts).filter("value IS NOT NULL")
        values[kind] = (long.selectExpr("cast(id AS int) AS id", "value").groupBy("value")
                        .agg(*[F.expr(b) for b in bits]))
    return values, words


def bitmaps(values: list[DataFrame], words: int) -> DataFrame:
    """The column bitmaps of all values, whatever their family."""
    return reduce(DataFrame.unionByName, [v.select(*[f"w{w}" for w in range(words)]) for v in values])


def _members(prefix: str, words: int) -> str:
    """SQL of the column ids in a bitmap."""
    parts = [f"transform(filter(sequence(0, {WORD - 1}), b -> getbit({prefix}{w}, b) = 1), b -> b + {w * WORD})"
             for w in range(words)]
    return f"concat({', '.join(parts)})"


def overlap_counts(values: DataFrame, words: int, only: list[int] | None = None) -> DataFrame:
    """(a, b, n): number of distinct values both columns hold, a <= b; a = b
    gives the number of values of a column. With `only`, pairs of two other
    columns are left out.

    Values with the same column set are counted first; only the sets spread.
    """
    bitmap = [f"w{w}" for w in range(words)]
    sets = values.groupBy(*bitmap).agg(F.count(F.lit(1)).alias("n"))
    pairs = (sets.selectExpr(f"{_members('w', words)} AS ids", "n")
             .selectExpr("posexplode(ids) AS (place, a)", "ids", "n"))
    others = "slice(ids, place + 1, size(ids))"
    if only is not None:
        wanted = f"array({', '.join(map(str, only)) or 'cast(null AS int)'})"
        others = f"filter({others}, b -> a = b OR array_contains({wanted}, a) OR array_contains({wanted}, b))"
    return (pairs.selectExpr("a", f"explode({others}) AS b", "n")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))


def jaccard(catalog: Catalog, table: str | None = None) -> DataFrame:
    """(table1, col1, table2, col2, weight): exact Jaccard of the distinct values
    of columns of two tables that share at least one (B3). With `table`, only
    pairs with one of its columns."""
    values, words = column_values(catalog)
    if not values:
        return _no_pairs(catalog)
    # One row per pair of columns.
    only = None if table is None else [i for i, t, _, _ in catalog.column_list() if t == table]
    counts = stage(overlap_counts(bitmaps(list(values.values()), words), words, only), "overlap")
    return _jaccard_of(catalog, counts, counts.filter("a < b"))


def _no_pairs(catalog: Catalog) -> DataFrame:
    return catalog.spark.createDataFrame(
        [], "table1 string, col1 string, table2 string, col2 string, weight double")


def _jaccard_of(catalog: Catalog, counts: DataFrame, shared: DataFrame) -> DataFrame:
    sizes = counts.filter("a = b").select(F.col("a").alias("id"), F.col("n").alias("size"))
    left = sizes.select(F.col("id").alias("a"), F.col("size").alias("na"))
    right = sizes.select(F.col("id").alias("b"), F.col("size").alias("nb"))
    cols = catalog.columns().select("col_id", F.col("table"), F.col("column"))
    c1 = cols.select(F.col("col_id").alias("a"), F.col("table").alias("table1"), F.col("column").alias("col1"))
    c2 = cols.select(F.col("col_id").alias("b"), F.col("table").alias("table2"), F.col("column").alias("col2"))
    return (shared.join(left, "a").join(right, "b").join(c1, "a").join(c2, "b")
            .filter(F.col("table1") != F.col("table2"))
            .selectExpr("table1", "col1", "table2", "col2", "n / (na + nb - n) AS weight"))


# -- names and types ---------------------------------------------------------


def trigrams(name: str) -> str:
    """SQL of the distinct 3-grams of a lower-cased name, padded by two spaces
    in front and one behind."""
    padded = f"concat('  ', lower({name}), ' ')"
    return f"array_distinct(transform(sequence(1, length(lower({name})) + 1), i -> substring({padded}, i, 3)))"


def schema_score(pairs: DataFrame) -> DataFrame:
    """Adds name_score and type_score to pairs (c1, c2) of column rows."""
    return (pairs.selectExpr("*", f"{_name_score('c1.column', 'c2.column')} AS name_score",
                             f"""CASE WHEN c1.family = c2.family THEN 1D
                             WHEN c1.family IN ('{INTEGRAL}', '{FRACTIONAL}')
                              AND c2.family IN ('{INTEGRAL}', '{FRACTIONAL}') THEN 0.5D
                             ELSE 0D END AS type_score"""))


def _name_score(x: str, y: str) -> str:
    """SQL of the mean of edit similarity and trigram similarity of two names."""
    a, b, g, h = f"lower({x})", f"lower({y})", trigrams(x), trigrams(y)
    return (f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))"
            f" + size(array_intersect({g}, {h})) / size(array_union({g}, {h}))) / 2")


def similar_names(names: DataFrame, least: float) -> DataFrame | None:
    """(n1, n2): pairs of different names, n1 < n2, that include all with a name
    score above `least`; None where names that share no trigram can have it.

    With k edits between them, at most 3 k of the n + 1 trigrams of the longer
    name are not in the other. Hence names without a common one are less than
    2/3 alike by edits. And where the longer name has n + 1 different ones, s of
    which are common, edit similarity is at most 1 - (n + 1 - s) / 3n and trigram
    similarity at most s / (n + 1), so a sum above c = 2 `least` takes more than
    (n + 1 - 3n (1 - c)) / 4 common ones. Pairs that have so many share one of
    their rarest when as many trigrams of each, less one, are left out, the most
    frequent first, and two when less two are. Names that repeat a trigram meet
    all that share one.
    """
    c = 2 * least
    if c < 2 / 3 - 1e-9:
        return None
    n = F.length(F.lower("name"))
    common = F.greatest(F.floor((n + 1 - 3 * n * F.lit(1 - c)) / 4 - 1e-9) + 1, F.lit(1)).cast("int")
    held = stage(names.select("name", F.expr(trigrams("name")).alias("grams"), n.alias("n"))
                 .withColumn("regular", F.size("grams") == F.col("n") + 1), "names")
    each = held.select("name", "regular", "n", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ordered = (each.join(often, "gram").groupBy("name", "n", "regular", "size")
               .agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams")))
    ordered = stage(ordered.withColumn("common", common), "rare-trigrams")
    prefix = lambda more: F.slice(F.transform("grams", lambda g: g["gram"]), F.lit(1), F.greatest(F.col("size") - F.col("common") + more, F.lit(1)))
    tokens = ordered.filter("regular AND common = 1").select("name", F.explode(prefix(1)).alias("token"))
    # With two common ones, one more of each name's rarest holds both: far fewer names share two.
    two = F.expr("flatten(transform(rare, (x, i) -> transform(slice(rare, i + 2, size(rare)), y -> concat(least(x, y), greatest(x, y)))))")
    pairs = ordered.filter("regular").select("name", prefix(2).alias("rare")).select("name", F.explode(two).alias("token"))
    tokens = stage(tokens.unionByName(pairs), "name-tokens")
    odd = each.filter("NOT regular").select("gram", "name")
    met = (tokens.withColumnRenamed("name", "n1").join(tokens.withColumnRenamed("name", "n2"), "token").filter("n1 < n2").select("n1", "n2")
           .unionByName(odd.withColumnRenamed("name", "x").join(each.select("gram", F.col("name").alias("y")), "gram").filter("x != y")
                        .select(F.least("x", "y").alias("n1"), F.greatest("x", "y").alias("n2"))))
    return met.distinct()


def _may_exceed(columns: DataFrame, least: float, table: str | None) -> DataFrame | None:
    """Pairs (c1, c2) of columns of two tables, the first table first by name,
    that include all with a name score above `least`. Names are compared once,
    in however many tables they stand."""
    pairs = similar_names(columns.select(F.col("column").alias("name")).distinct(), least)
    if pairs is None:
        return None
    alike = stage(pairs.filter(f"{_name_score('n1', 'n2')} > {least - 1e-9!r}D"), "similar-names")
    same = columns.select(F.col("column").alias("n1"), F.col("column").alias("n2")).distinct()
    every = same.unionByName(alike).unionByName(alike.select(F.col("n2").alias("n1"), F.col("n1").alias("n2")))
    first = columns.select(F.col("column").alias("n1"), F.struct("*").alias("c1"))
    second = columns.select(F.col("column").alias("n2"), F.struct("*").alias("c2"))
    ours = F.lit(True) if table is None else (F.col("c1.table") == table) | (F.col("c2.table") == table)
    return every.join(first, "n1").join(second, "n2").filter((F.col("c1.table") < F.col("c2.table")) & ours).select("c1", "c2")


def composite(catalog: Catalog, instances: bool = False, table: str | None = None,
              above: float | None = None) -> DataFrame:
    """(table1, col1, table2, col2, name_score, type_score, inst_score, weight):
    similarity of names and types and, with `instances`, of values (B2). With
    `table`, only pairs with one of its columns. With `above`, pairs whose names
    rule a greater weight out are not looked at, and only greater ones come back."""
    weights = INSTANCE_WEIGHTS if instances else SCHEMA_WEIGHTS
    columns = catalog.columns()
    shared = jaccard(catalog, table).withColumnRenamed("weight", "inst_score") if instances else None
    pairs = None
    if above is not None:
        # What a pair without common values must owe to its names.
        pairs = _may_exceed(columns, (above - weights["type"]) / weights["name"], table)
        if pairs is not None and shared is not None:
            shared = stage(shared, "shared-values")
            first = columns.select(F.col("table").alias("table1"), F.col("column").alias("col1"), F.struct("*").alias("c1"))
            second = columns.select(F.col("table").alias("table2"), F.col("column").alias("col2"), F.struct("*").alias("c2"))
            pairs = pairs.unionByName(shared.join(first, ["table1", "col1"]).join(second, ["table2", "col2"]).select("c1", "c2")).distinct()
    if pairs is None:
        pairs = column_pairs(columns)
        if table is not None:
            pairs = pairs.filter((F.col("c1.table") == table) | (F.col("c2.table") == table))
    scored = schema_score(pairs).selectExpr(
        "c1.table AS table1", "c1.column AS col1", "c2.table AS table2", "c2.column AS col2",
        "name_score", "type_score")
    if instances:
        scored = scored.join(shared, ["table1", "col1", "table2", "col2"], "left").fillna(0.0, ["inst_score"])
    else:
        scored = scored.withColumn("inst_score", F.lit(0.0))
    weight = (F.col("name_score") * weights["name"] + F.col("type_score") * weights["type"]
              + F.col("inst_score") * weights["inst"])
    scored = scored.withColumn("weight", weight)
    return scored if above is None else scored.filter(F.col("weight") > above)


# -- near-equal values -------------------------------------------------------


def near_jaccard(catalog: Catalog, near: float = NEAR, table: str | None = None) -> DataFrame:
    """Jaccard where a string value counts as shared if some value on the other
    side is near-equal: 1 - distance / longer length >= `near` (B3, fuzzy form).

    The values of the smaller column are looked up in the larger one; equal
    sizes go by column id. Other types count as shared when equal. With `table`,
    only pairs with one of its columns.
    """
    values, words = column_values(catalog, whole=True)
    if STRING not in values:
        return jaccard(catalog, table)
    strings = stage(values.pop(STRING).withColumnRenamed("value", "chars"), "strings")
    exact = stage(overlap_counts(bitmaps(list(values.values()), words), words), "overlap") if values else None
    equal = stage(overlap_counts(bitmaps([strings], words), words), "overlap")
    counts = equal if exact is None else exact.unionByName(equal)
    sizes = counts.filter("a = b").select(F.col("a").alias("id"), F.col("n").alias("size"))
    # One row per column of strings: what the driver sees of the lake is its schema.
    wanted = _wanted(catalog, {r["id"]: r["size"] for r in equal.filter("a = b").selectExpr("a AS id", "n AS size").collect()}, table)
    reach = near_columns(strings, words, near, wanted)
    # (a, b, n): values of a with a near value in b, both ways round.
    reached = (reach.groupBy(*[f"w{w}" for w in range(words)], *[f"r{w}" for w in range(words)])
               .agg(F.count(F.lit(1)).alias("n"))
               .selectExpr(f"explode({_members('w', words)}) AS a", f"{_members('r', words)} AS ids", "n")
               .selectExpr("a", "explode(ids) AS b", "n").filter("a != b"))
    found = reached
    if exact is not None:
        apart = exact.filter("a < b")
        found = apart.unionByName(apart.selectExpr("b AS a", "a AS b", "n")).unionByName(reached)
    small = (found.groupBy("a", "b").agg(F.sum("n").alias("n")).join(sizes.selectExpr("id AS a", "size AS na"), "a")
             .join(sizes.selectExpr("id AS b", "size AS nb"), "b")
             .filter("na < nb OR (na = nb AND a < b)")
             .selectExpr("least(a, b) AS a", "greatest(a, b) AS b", "n"))
    pairs = _jaccard_of(catalog, counts, small)
    return pairs if table is None else pairs.filter((F.col("table1") == table) | (F.col("table2") == table))


def _wanted(catalog: Catalog, sizes: dict[int, int], table: str | None) -> dict[int, list[int]]:
    """For each string column the columns its values are looked up in: larger
    ones of other tables."""
    of = {i: t for i, t, _, kind in catalog.column_list() if kind == STRING and i in sizes}
    return {a: [b for b in of if of[a] != of[b] and (sizes[a], a) < (sizes[b], b)
                and (table is None or table in (of[a], of[b]))] for a in of}


def _masks(ids: list[int], words: int) -> list[int]:
    return [sum(1 << (i % WORD) for i in ids if i // WORD == w) for w in range(words)]


def _closed(strings: DataFrame, words: int, wanted: dict[int, list[int]]) -> DataFrame:
    """Adds c0, c1, ...: the columns a value need not be looked for in, for it
    stands in none that is looked up there.

    There are far fewer column sets than values, and they are only broadcast
    when few; without them nothing is closed, which costs time but no result.
    """
    sets, seen = stage_observed(strings.groupBy(*[f"w{w}" for w in range(words)]).agg(F.count(F.lit(1)).alias("n")),
                                "column-sets", F.count(F.lit(1)).alias("rows"))
    if int(seen["rows"] or 0) > MAX_SETS:
        return strings.selectExpr("*", *[f"0L AS c{w}" for w in range(words)])
    rows = [(i, *_masks(ids, words)) for i, ids in wanted.items()]
    masks = strings.sparkSession.createDataFrame(rows, ", ".join(["id int"] + [f"m{w} long" for w in range(words)]))
    on = [f"w{w}" for w in range(words)]
    wide = (sets.selectExpr(*on, f"explode({_members('w', words)}) AS id").join(masks, "id").groupBy(*on)
            .agg(*[F.expr(f"~bit_or(m{w}) AS c{w}") for w in range(words)]))
    return strings.join(F.broadcast(wide), on)


def near_columns(values: DataFrame, words: int, near: float = NEAR,
                 wanted: dict[int, list[int]] | None = None) -> DataFrame:
    """Adds r0, r1, ...: the bitmap of the columns that hold a near-equal value,
    as far as they are `wanted` for the columns of the value.

    `values` has distinct `chars` with column bitmaps w0, w1, ... Four steps,
    each on what the one before left open:

    1. Values that agree after dropping one character from each are at most two
       edits apart. Bitmaps are merged per shortened form, so a crowd of similar
       values costs one row per form and never meets pairwise.
    2. Writing 9 for every digit never makes two values differ more. Columns
       are only looked for behind near patterns; a million numbered names are
       one pattern.
    3. The rest is compared where a segment agrees, with a few values of the
       other side first, then with more: who has found all columns stops.
    4. Values of more than LONG_VALUE characters are compared by the grams that
       a distance within the limit must leave in place.
    """
    bits = range(words)
    bitmap = [f"w{i}" for i in bits]
    slack = 1 - near
    if wanted is None:
        closed = values.selectExpr("*", *[f"0L AS c{i}" for i in bits])
    else:
        closed = _closed(values, words, wanted)
    is_short = F.length("chars") <= LONG_VALUE
    brief = closed.filter(is_short)
    # With room for two edits, sharing a shortened form is proof enough.
    roomy = brief.filter(f"floor({slack} * length(chars) + 1e-9D) >= 2")
    forms = roomy.selectExpr("chars", *bitmap, f"""explode(array_distinct(concat(array(chars),
        transform(sequence(1, length(chars)), i -> concat(substring(chars, 1, i - 1),
        substring(chars, i + 1, length(chars))))))) AS form""")
    merged = forms.groupBy("form").agg(*[F.expr(f"bit_or(w{i}) AS m{i}") for i in bits])
    by_form = (forms.select("chars", "form").join(merged, "form").groupBy("chars")
               .agg(*[F.expr(f"bit_or(m{i}) AS f{i}") for i in bits]))
    # k: the columns known to hold a near value, or not to be of interest.
    known, seen = stage_observed(brief.join(by_form, "chars", "left").selectExpr(
        "chars", "translate(chars, '0123456789', '9999999999') AS pattern", *bitmap,
        *[f"w{i} | coalesce(f{i}, 0L) AS g{i}" for i in bits],
        *[f"w{i} | coalesce(f{i}, 0L) | c{i} AS k{i}" for i in bits]), "near",
        F.collect_set(F.length("chars")).alias("lengths"), F.count(F.lit(1)).alias("rows"))
    lengths = sorted(seen["lengths"] or [])

    patterns = known.groupBy("pattern").agg(*[F.expr(f"bit_or(w{i}) AS p{i}") for i in bits])
    patterns = stage(patterns.withColumnRenamed("pattern", "chars"), "patterns")
    alike = near_pairs(patterns.select("chars"), patterns, slack, lengths).unionByName(
        patterns.withColumn("other", F.col("chars")))
    alike = alike.distinct().withColumnRenamed("chars", "pattern").withColumnRenamed("other", "target")
    openings = " OR ".join(f"(p{i} & ~k{i}) != 0" for i in bits)
    still = stage(known.join(alike, "pattern").filter(openings).select(
        "chars", "target", *[f"k{i}" for i in bits]), "open")

    useful = " OR ".join(f"(w{i} & ~k{i}) != 0" for i in bits)
    right = known.withColumnRenamed("pattern", "target").select("chars", "target", *bitmap)
    found = _by_rounds(still, right, int(seen["rows"] or 0), slack, lengths, useful, words)
    short = (known.join(found, "chars", "left")
             .selectExpr("chars", *bitmap, *[f"g{i} | coalesce(s{i}, 0L) AS r{i}" for i in bits]))
    long = closed.filter(~is_short).selectExpr("chars", *bitmap, *[f"w{i} AS r{i}" for i in bits])

    # Some values that segments reach are near to longer ones as well.
    far = near_long_columns(stage(closed.filter(F.length("chars") >= near * (LONG_VALUE + 1) - 1e-9), "long-strings"), words, slack, LONG_VALUE)
    return (short.unionByName(long).withColumn("md5", F.md5("chars")).join(far, "md5", "left")
            .selectExpr(*bitmap, *[f"r{i} | coalesce(s{i}, 0L) AS r{i}" for i in bits]))


def _by_rounds(still: DataFrame, right: DataFrame, rows: int, slack: float, lengths: list[int],
               useful: str, words: int) -> DataFrame:
    """chars, s0, s1, ...: the columns of near values of `right`.

    Values are dealt into slices by hash, the first of FIRST_SLICE values, each
    further one SLICE_GROWTH times as large. What is still open after a slice
    meets the next one, so a crowd of values that are near to many others is
    through after a slice or two, and the others meet every value.
    """
    bits = range(words)
    place = F.pmod(F.xxhash64("chars"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    edges, size = [0.0], FIRST_SLICE
    while size < rows:
        edges.append(size / rows)
        size *= SLICE_GROWTH
    edges.append(1.0)
    found = None
    for turn, (low, high) in enumerate(zip(edges, edges[1:])):
        part = right if len(edges) == 2 else right.filter((place >= low) & (place < high))
        close = near_pairs(still, part, slack, lengths, ["target"], useful)
        new = close.groupBy("chars").agg(*[F.expr(f"bit_or(w{i}) AS s{i}") for i in bits])
        if turn + 2 == len(edges):
            return new if found is None else found.unionByName(new).groupBy("chars").agg(
                *[F.expr(f"bit_or(s{i}) AS s{i}") for i in bits])
        new = stage(new, "near-slice")
        found = new if found is None else found.unionByName(new)
        still = stage(still.join(new, "chars", "left").selectExpr(
            "chars", "target", *[f"k{i} | coalesce(s{i}, 0L) AS k{i}" for i in bits]), "open")


def near_pairs(left: DataFrame, right: DataFrame, slack: float, lengths: list[int],
               keys: list[str] | None = None, useful: str = "true") -> DataFrame:
    """Pairs of different `chars` of `left` and `other` of `right` within the
    edits their longer length allows, equal in `keys` and `useful`.

    Such a pair shares one of edits + 1 even segments of the shorter value.
    Taking the first segment left whole bounds how far it has moved: by no more
    edits than there are segments before it, and, seen from the end, by no more
    than there are behind it. Only lengths that occur are cut. A pair comes once
    per segment shared.
    """
    present = f"array({', '.join(str(n) for n in lengths) or '0'})"
    allowed = f"cast(floor({slack} * big + 1e-9D) AS int) AS edits"
    cut = """transform(sequence(0, edits), j -> struct(j AS part,
        cast(floor(j * small / (edits + 1)) AS int) AS at,
        cast(floor((j + 1) * small / (edits + 1)) AS int) - cast(floor(j * small / (edits + 1)) AS int) AS len))"""
    first = "greatest(0, at - part, at + big - small - (edits - part))"
    final = "least(big - len, at + part, at + big - small + (edits - part))"

    def as_small(df: DataFrame, longer: str) -> DataFrame:
        return (df.selectExpr("*", "length(chars) AS small", f"explode({present}) AS big")
                .filter(f"big {longer} small").selectExpr("*", allowed).filter("big - small <= edits")
                .selectExpr("*", f"inline({cut})")
                .withColumn("segment", F.expr("substring(chars, at + 1, len)")).drop("at", "len"))

    def as_big(df: DataFrame, longer: str) -> DataFrame:
        return (df.selectExpr("*", "length(chars) AS big", f"explode({present}) AS small")
                .filter(f"big {longer} small AND small > 0").selectExpr("*", allowed)
                .filter("big - small <= edits").selectExpr("*", f"inline({cut})")
                .selectExpr("*", f"{first} AS lo", f"{final} AS hi").filter("lo <= hi")
                .selectExpr("*", "explode(sequence(lo, hi)) AS place")
                .withColumn("segment", F.expr("substring(chars, place + 1, len)"))
                .drop("at", "len", "lo", "hi", "place").distinct())

    on = ["small", "big", "edits", "part", "segment"] + (keys or [])

    def matched(a: DataFrame, b: DataFrame) -> DataFrame:
        return (a.join(b.withColumnRenamed("chars", "other"), on).filter(useful)
                .filter("chars != other AND levenshtein(chars, other, edits) >= 0")
                .drop("small", "big", "edits", "part", "segment"))

    return matched(as_small(left, ">="), as_big(right, ">=")).unionByName(
        matched(as_big(left, ">"), as_small(right, ">")))


# -- discovery ---------------------------------------------------------------


def find_relationships(catalog: Catalog, threshold: float = 0.5, matcher: str = "coma",
                       instances: bool = False, fuzzy: bool = True, table: str | None = None) -> DataFrame:
    """Edges above the threshold over all table pairs, or those with `table`, both directions."""
    if matcher == "jaccard":
        pairs = near_jaccard(catalog, table=table) if fuzzy else jaccard(catalog, table)
    elif matcher == "coma":
        pairs = composite(catalog, instances, table, threshold)
    else:
        raise ValueError("matcher must be 'coma' or 'jaccard'")
    if table is not None:
        pairs = pairs.filter((F.col("table1") == table) | (F.col("table2") == table))
    kept = above(pairs, threshold).selectExpr(
        "table1 AS from_table", "table2 AS to_table", "col1 AS from_col", "col2 AS to_col", "weight")
    return both_directions(kept)
