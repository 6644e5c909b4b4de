"""The same results in DuckDB SQL."""

from __future__ import annotations

from checks.queries import ALL, CHAIN, CHOSEN, CODES, GIVEN, KEYS, LINKS, NEW, NUMBERS, RULES, SAVED, STAR, TARGET

# Columns of the given tables by type family; nested columns take no part.
COLUMNS = {
    "benchmark": "item_id:integral text:string",
    "conversations": "conv_id:integral turn:integral role:string text:string",
    "customer": "c_custkey:integral c_name:string c_nationkey:integral c_acctbal:fractional c_mktsegment:string",
    "documents": "doc_id:integral text:string lang:string source:string n_chars:integral",
    "embeddings": "vec_id:integral label:integral",
    "events": "event_id:integral ts:timestamp user_id:integral event_type:string value:fractional props:string",
    "labels": "doc_id:integral quality:integral toxic:integral",
    "lineitem": "l_orderkey:integral l_partkey:integral l_suppkey:integral l_linenumber:integral "
                "l_quantity:fractional l_extendedprice:fractional l_discount:fractional l_tax:fractional "
                "l_returnflag:string l_linestatus:string l_shipdate:timestamp",
    "nation": "n_nationkey:integral n_name:string n_regionkey:integral",
    "orders": "o_orderkey:integral o_custkey:integral o_orderstatus:string o_totalprice:fractional "
              "o_orderdate:timestamp o_orderpriority:string",
    "pages": "page_id:integral url:string html:string",
    "part": "p_partkey:integral p_name:string p_brand:string p_type:string p_size:integral "
            "p_retailprice:fractional",
    "region": "r_regionkey:integral r_name:string",
    "supplier": "s_suppkey:integral s_name:string s_nationkey:integral s_acctbal:fractional",
}
EPS = "1e-12"
ALL_OF_CHAIN = CHAIN


def cols(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[table].split()]


def num(expr: str, kind: str) -> str:
    return f"epoch_us({expr}) / 1e6" if kind == "timestamp" else f"CAST({expr} AS DOUBLE)"


def rnd(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {name}"


# -- relationships -----------------------------------------------------------


def values_cte(tables: list[str]) -> str:
    """vals(t, c, family, whole, real, chars): distinct values of every column."""
    parts = []
    for t in tables:
        for c, kind in cols(t):
            whole = f"CAST({c} AS BIGINT)" if kind == "integral" else (
                f"epoch_us({c})" if kind == "timestamp" else "CAST(NULL AS BIGINT)")
            real = c if kind == "fractional" else "CAST(NULL AS DOUBLE)"
            chars = c if kind == "string" else "CAST(NULL AS VARCHAR)"
            parts.append(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{kind}' AS family, {whole} AS whole, "
                         f"{real} AS real, {chars} AS chars FROM {t} WHERE {c} IS NOT NULL")
    return "vals AS (" + " UNION ALL ".join(parts) + ")"


def jaccard_cte(tables: list[str]) -> str:
    """jac(table1, col1, table2, col2, weight), plus sizes(t, c, n)."""
    return f"""{values_cte(tables)},
sizes AS (SELECT t, c, count(*) AS n FROM vals GROUP BY t, c),
shared AS (SELECT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2, count(*) AS n FROM vals a JOIN vals b
  ON a.family = b.family AND a.whole IS NOT DISTINCT FROM b.whole AND a.real IS NOT DISTINCT FROM b.real
  AND a.chars IS NOT DISTINCT FROM b.chars AND a.t < b.t GROUP BY 1, 2, 3, 4),
jac AS (SELECT t1 AS table1, c1 AS col1, t2 AS table2, c2 AS col2,
  s.n / CAST(x.n + y.n - s.n AS DOUBLE) AS weight FROM shared s
  JOIN sizes x ON x.t = t1 AND x.c = c1 JOIN sizes y ON y.t = t2 AND y.c = c2)"""


def both(pairs: str, threshold: float = 0.5) -> str:
    """edges from pairs(table1, col1, table2, col2, weight)."""
    return f"""edges AS (SELECT table1 AS from_table, table2 AS to_table, col1 AS from_col, col2 AS to_col, weight
  FROM {pairs} WHERE weight > {threshold} UNION ALL
  SELECT table2, table1, col2, col1, weight FROM {pairs} WHERE weight > {threshold})"""


def on_edges(select: str, tables: list[str] = ALL, more: str = "", recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{jaccard_cte(tables)}, {both('jac')}{more} {select}"


EDGE_COLS = "from_table, to_table, from_col, to_col, " + rnd("weight", "weight")


def columns_cte(tables: list[str]) -> str:
    rows = ", ".join(f"('{t}', '{c}', '{k}')" for t in tables for c, k in cols(t))
    return f"""cols(t, c, family) AS (VALUES {rows}),
grams AS (SELECT t, c, family, list_distinct([substr('  ' || lower(c) || ' ', CAST(i AS BIGINT), 3)
  FOR i IN range(1, length(c) + 2)]) AS g FROM cols)"""


def composite_cte(tables: list[str]) -> str:
    """comp(table1, col1, table2, col2, name_score, type_score, inst_score, weight)."""
    return f"""{jaccard_cte(tables)}, {columns_cte(tables)},
named AS (SELECT a.t AS table1, a.c AS col1, b.t AS table2, b.c AS col2,
  ((1 - levenshtein(lower(a.c), lower(b.c)) / CAST(greatest(length(a.c), length(b.c)) AS DOUBLE))
   + len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE)) / 2 AS name_score,
  CASE WHEN a.family = b.family THEN 1.0::DOUBLE WHEN a.family IN ('integral', 'fractional')
    AND b.family IN ('integral', 'fractional') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS type_score
  FROM grams a JOIN grams b ON a.t < b.t),
comp AS (SELECT n.*, coalesce(j.weight, 0.0) AS inst_score,
  0.7 * name_score + 0.1 * type_score + 0.2 * coalesce(j.weight, 0.0) AS weight
  FROM named n LEFT JOIN jac j USING (table1, col1, table2, col2))"""


def matcher_quality() -> str:
    known = ", ".join(f"('{min(x, y)[0]}', '{min(x, y)[1]}', '{max(x, y)[0]}', '{max(x, y)[1]}')" for a, b, c, d in KEYS for x, y in [((a, b), (c, d))])
    return f"""WITH {jaccard_cte(STAR)}, {columns_cte(STAR)},
named AS (SELECT a.t AS table1, a.c AS col1, b.t AS table2, b.c AS col2,
  ((1 - levenshtein(lower(a.c), lower(b.c)) / CAST(greatest(length(a.c), length(b.c)) AS DOUBLE))
   + len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE)) / 2 AS name_score,
  CASE WHEN a.family = b.family THEN 1.0::DOUBLE WHEN a.family IN ('integral', 'fractional')
    AND b.family IN ('integral', 'fractional') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS type_score
  FROM grams a JOIN grams b ON a.t < b.t),
known(table1, col1, table2, col2) AS (VALUES {known}),
scored AS (SELECT 'coma' AS matcher, table1, col1, table2, col2, 0.875 * name_score + 0.125 * type_score AS weight FROM named
  UNION ALL SELECT 'jaccard', * FROM jac),
counts AS (SELECT matcher, round(weight, 6) AS threshold, count(*) AS n, count(k.table1) AS h
  FROM scored LEFT JOIN known k USING (table1, col1, table2, col2) GROUP BY 1, 2),
kept AS (SELECT matcher, threshold, CAST(sum(n) OVER w AS BIGINT) AS pairs, CAST(sum(h) OVER w AS BIGINT) AS hits FROM counts
  WINDOW w AS (PARTITION BY matcher ORDER BY threshold DESC))
SELECT matcher, {rnd("threshold", "threshold")}, pairs, hits, {rnd("hits / CAST(pairs AS DOUBLE)", "precision")},
  {rnd(f"hits / CAST({len(KEYS)} AS DOUBLE)", "recall")} FROM kept"""


def near_jaccard() -> str:
    ids = ", ".join(f"('{t}', '{c}', {i})" for i, (t, c) in enumerate(
        (t, c) for t in sorted(ALL) for c, _ in cols(t)))
    return f"""WITH {jaccard_cte(ALL)}, ids(t, c, id) AS (VALUES {ids}),
pairs AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, a.n AS na, b.n AS nb, a.id < b.id AS forth
  FROM (SELECT * FROM sizes JOIN ids USING (t, c)) a JOIN (SELECT * FROM sizes JOIN ids USING (t, c)) b
  ON a.t != b.t AND (a.n < b.n OR (a.n = b.n AND a.id < b.id))),
exact AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(*) AS n FROM vals a JOIN vals b
  ON a.family = b.family AND a.whole IS NOT DISTINCT FROM b.whole AND a.real IS NOT DISTINCT FROM b.real
  AND a.chars IS NOT DISTINCT FROM b.chars AND a.t != b.t
  WHERE a.family != 'string' GROUP BY 1, 2, 3, 4),
-- levenshtein counts bytes here: each letter beyond ASCII is written as a control character of its own.
alpha AS MATERIALIZED (SELECT coalesce(string_agg(ch, '' ORDER BY ch), '') AS f FROM (SELECT DISTINCT unnest(string_split(chars, '')) AS ch FROM vals
  WHERE family = 'string') WHERE ord(ch) > 127),
codes AS MATERIALIZED (SELECT string_agg(chr(CAST(x AS INTEGER)), '' ORDER BY x) AS f FROM range(1, 32) r(x) WHERE x NOT BETWEEN 9 AND 13),
texts AS MATERIALIZED (SELECT t, c, chars, length(chars) AS n, translate(chars, (SELECT f FROM alpha), (SELECT f FROM codes)) AS one
  FROM vals WHERE family = 'string'),
brief AS (SELECT DISTINCT chars, n, one FROM texts WHERE n <= 64),
-- Long strings only meet where the result needs them, and where enough grams are the same: an edit changes three at most.
strs AS MATERIALIZED (SELECT chars, n, one, row_number() OVER () AS id FROM (SELECT DISTINCT chars, n, one FROM texts WHERE n >= 52)),
grams AS MATERIALIZED (SELECT id, list(hash(g, o)) AS h FROM (SELECT id, g, row_number() OVER (PARTITION BY id, g) AS o FROM
  (SELECT id, substr(chars, CAST(i AS BIGINT), 3) AS g FROM (SELECT id, chars, unnest(range(1, n - 1)) AS i FROM strs))) GROUP BY id),
held AS MATERIALIZED (SELECT t, c, id, s.n FROM texts JOIN strs s USING (chars)),
long AS MATERIALIZED (SELECT DISTINCT a.id AS x, b.id AS y, greatest(a.n, b.n) AS big, CAST(floor(0.2 * greatest(a.n, b.n) + 1e-9) AS BIGINT) AS k
  FROM pairs p JOIN held a ON a.t = ta AND a.c = ca JOIN held b ON b.t = tb AND b.c = cb
  AND b.n BETWEEN a.n * 0.8 - 1e-9 AND a.n / 0.8 + 1e-9 WHERE a.n > 64 OR b.n > 64),
alike AS MATERIALIZED (SELECT x, y, k FROM long JOIN grams p ON p.id = x JOIN grams q ON q.id = y
  WHERE len(list_intersect(p.h, q.h)) >= big - 2 - 3 * k),
near AS (SELECT a.chars AS x, b.chars AS y FROM brief a JOIN brief b
  ON b.n BETWEEN a.n * 0.8 - 1e-9 AND a.n / 0.8 + 1e-9
  WHERE levenshtein(a.one, b.one) <= floor(0.2 * greatest(a.n, b.n) + 1e-9)
  UNION ALL SELECT p.chars, q.chars FROM alike JOIN strs p ON p.id = x JOIN strs q ON q.id = y WHERE levenshtein(p.one, q.one) <= k),
fuzzy AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(DISTINCT a.chars) AS n
  FROM texts a JOIN near ON a.chars = x JOIN texts b ON b.chars = y AND a.t != b.t GROUP BY 1, 2, 3, 4),
found AS (SELECT ta, ca, tb, cb, sum(n) AS n FROM (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy) GROUP BY 1, 2, 3, 4)
SELECT CASE WHEN forth THEN ta ELSE tb END AS table1, CASE WHEN forth THEN ca ELSE cb END AS col1,
  CASE WHEN forth THEN tb ELSE ta END AS table2, CASE WHEN forth THEN cb ELSE ca END AS col2,
  {rnd("n / CAST(na + nb - n AS DOUBLE)", "weight")}
FROM found JOIN pairs USING (ta, ca, tb, cb)"""


# -- joins ---------------------------------------------------------------------


def one(table: str, key: str) -> str:
    others = ", ".join(f"{c} ASC NULLS FIRST" for c, _ in cols(table) if c != key)
    return (f"(SELECT * FROM {table} WHERE {key} IS NOT NULL "
            f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {others}) = 1)")


def ratios_cte() -> str:
    parts = [f"SELECT '{t1}' AS from_table, '{c1}' AS from_col, '{t2}' AS to_table, '{c2}' AS to_col, "
             f"avg(CASE WHEN l.{c1} IN (SELECT {c2} FROM {t2}) THEN 1.0 ELSE 0.0 END) AS ratio FROM {t1} l"
             for t1, c1, t2, c2 in LINKS]
    return "ratios AS (" + " UNION ALL ".join(parts) + ")"


ORDERS_FEATURES = [(c, k) for c, k in cols("orders") if c != "o_orderstatus"]
JOINED = f"""j AS (SELECT o.*, c.*, n.*, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders o
  LEFT JOIN {one('customer', 'c_custkey')} c ON o_custkey = c_custkey
  LEFT JOIN {one('nation', 'n_nationkey')} n ON c_nationkey = n_nationkey)"""


def short(name: str) -> str:
    return name.split("__")[1]


def long_cte(names: list[str], source: str = "j", extra: str = "") -> str:
    parts = [f"SELECT '{n}' AS feature, o_orderkey AS rid, y, CAST({short(n)} AS DOUBLE) AS v FROM {source}"
             for n in names]
    return "long AS (" + " UNION ALL ".join(parts) + extra + ")"


RANKS = """ranks AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v)
  + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM long WHERE v IS NOT NULL AND y IS NOT NULL)"""


def safe(expr: str) -> str:
    return f"(CASE WHEN {expr} IS NULL OR isnan({expr}) THEN 0.0 ELSE {expr} END)"


def corr(x: str, y: str = "y") -> str:
    """Correlation that is 0 without variance on either side."""
    return safe(f"(CASE WHEN min({x}) = max({x}) OR min({y}) = max({y}) THEN 0.0 ELSE corr({x}, {y}) END)")


CONSTANT = " UNION ALL SELECT 'constant', o_orderkey, y, 1.0::DOUBLE FROM j"
LEAK = CONSTANT + " UNION ALL SELECT 'leak', o_orderkey, y, y * 2.0 FROM j"
BINS = """lims AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature),
bins AS (SELECT feature, rid, y, CASE WHEN v IS NULL THEN 0 WHEN lo = hi THEN 1
  ELSE least(CAST(floor((v - lo) / (hi - lo) * 5) AS INT), 4) + 1 END AS bin FROM long JOIN lims USING (feature))"""


def entropy(*exprs: str) -> str:
    """Scalar subquery: joint entropy of expressions over j."""
    keys = ", ".join(f"coalesce(CAST({e} AS VARCHAR), '\x01')" for e in exprs)
    return (f"(SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM "
            f"(SELECT CAST(count(*) AS DOUBLE) AS n FROM j GROUP BY {keys}))")


def mutual(x: str, y: str) -> str:
    return f"({entropy(x)} + {entropy(y)} - {entropy(x, y)})"


def conditional(x: str, y: str, z: str) -> str:
    return f"({entropy(x, z)} + {entropy(y, z)} - {entropy(x, y, z)} - {entropy(z)})"


def measures(rows: list[tuple[str, str]]) -> str:
    return f"WITH {JOINED} " + " UNION ALL ".join(
        f"SELECT '{n}' AS measure, {rnd(e, 'score')}" for n, e in rows)


def mi_pairs_cte(name: str, left: str, right: str) -> str:
    """name(s, f, mi): mutual information of binned pairs."""
    return f"""{name}_c AS (SELECT a.feature AS s, b.feature AS f, a.bin AS x, b.bin AS z, CAST(count(*) AS DOUBLE) AS n
  FROM {left} a JOIN {right} b ON a.rid = b.rid GROUP BY 1, 2, 3, 4),
{name} AS (SELECT s, f, sum(n / t * ln(n * t / (nx * nz))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY s, f) AS t,
  sum(n) OVER (PARTITION BY s, f, x) AS nx, sum(n) OVER (PARTITION BY s, f, z) AS nz FROM {name}_c) GROUP BY s, f)"""


def mi_target_cte(name: str, source: str) -> str:
    return f"""{name}_c AS (SELECT feature AS f, bin AS x, y, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY 1, 2, 3),
{name} AS (SELECT f, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY f) AS t,
  sum(n) OVER (PARTITION BY f, x) AS nx, sum(n) OVER (PARTITION BY f, y) AS ny FROM {name}_c) GROUP BY f)"""


def norm(scores: str) -> str:
    """Min-max over scores(feature, score)."""
    return f"""SELECT feature, CASE WHEN hi - lo > {EPS} THEN round((score - lo) / (hi - lo), 12) ELSE 0.0 END AS score
  FROM (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi, max(abs(score)) OVER () AS peak FROM {scores})
  WHERE peak > {EPS}"""


def listed(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


MRMR = f"""WITH {JOINED}, {long_cte(NEW + CHOSEN)}, {BINS},
newb AS (SELECT * FROM bins WHERE feature IN ({listed(NEW)})),
selb AS (SELECT * FROM bins WHERE feature IN ({listed(CHOSEN)})),
{mi_target_cte('rel', 'newb')}, {mi_pairs_cte('red', 'selb', 'newb')},
mrmr AS (SELECT f AS feature, rel.mi - r.m AS score FROM rel JOIN (SELECT f, avg(mi) AS m FROM red GROUP BY f) r USING (f))"""


def raw_mrmr(selected: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {mutual(short(f), 'y')} - ("
        + " + ".join(mutual(short(s), short(f)) for s in selected) + f") / {len(selected)} AS score" for f in NEW)
    return f"WITH {JOINED}, raw AS ({rows})"


# -- hops ---------------------------------------------------------------------------


IS_F = "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"


def hop_start(table: str = "orders", rid: str = "o_orderkey", y: str = IS_F, features=tuple(ORDERS_FEATURES)) -> str:
    """rows0 (joined rows so far), sel0(feature, rid, bin): base features, binned."""
    parts = []
    for c, kind in features:
        v = num(c, kind) if kind != "string" else (
            f"CASE WHEN {c} IS NULL THEN NULL ELSE CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS DOUBLE) END")
        parts.append(f"SELECT '{table}__{c}' AS feature, rid, {v} AS v FROM rows0")
    return f"""rows0 AS (SELECT *, {rid} AS rid, {y} AS y FROM {table}),
long0 AS ({' UNION ALL '.join(parts)}),
lim0 AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long0 GROUP BY feature HAVING min(v) < max(v)),
sel0 AS (SELECT feature, rid, CASE WHEN v IS NULL THEN 0 ELSE least(CAST(floor((v - lo) / (hi - lo) * 5) AS INT), 4) + 1 END AS bin
  FROM long0 JOIN lim0 USING (feature))"""


def hop(i: int, table: str, left: str, right: str, k: int = 10, prefix: str = "") -> str:
    """Hop number i onto rows{i-1} and sel{i-1}: rel{i}, top{i}, red{i}, kept{i}, score{i}, sel{i}, rows{i}."""
    p = i - 1
    parts = []
    for name, kind in cols(table):
        c = prefix + name
        v = num(c, kind) if kind != "string" else (
            f"CASE WHEN {c} IS NULL THEN NULL ELSE CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS DOUBLE) END")
        parts.append(f"SELECT '{table}__{name}' AS feature, rid, y, {v} AS v FROM rows{i}")
    renamed = ", ".join(f"{c} AS {prefix}{c}" for c, _ in cols(table))
    other = f"(SELECT {renamed} FROM {one(table, right)})" if prefix else one(table, right)
    return f"""rows{i} AS (SELECT l.*, r.* FROM rows{p} l LEFT JOIN {other} r ON l.{left} = r.{prefix}{right}),
long{i} AS ({' UNION ALL '.join(parts)}),
lim{i} AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long{i} GROUP BY feature HAVING min(v) < max(v)),
rk{i} AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v)
  + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM long{i} JOIN lim{i} USING (feature) WHERE v IS NOT NULL),
rel{i} AS (SELECT feature, round(abs({corr('rk')}), 12) AS score FROM rk{i} GROUP BY feature),
top{i} AS (SELECT feature, score FROM rel{i} WHERE score > {EPS} AND score < 1 - {EPS} ORDER BY score DESC, feature LIMIT {k}),
new{i} AS (SELECT feature, rid, y, CASE WHEN v IS NULL THEN 0
  ELSE least(CAST(floor((v - lo) / (hi - lo) * 5) AS INT), 4) + 1 END AS bin
  FROM long{i} JOIN lim{i} USING (feature) WHERE feature IN (SELECT feature FROM top{i})),
{mi_target_cte(f'mt{i}', f'new{i}')}, {mi_pairs_cte(f'mp{i}', f'sel{p}', f'new{i}')},
mrmr{i} AS (SELECT f AS feature, t.mi - r.m AS score FROM mt{i} t JOIN (SELECT f, avg(mi) AS m FROM mp{i} GROUP BY f) r USING (f)),
red{i} AS ({norm(f'mrmr{i}')}),
kept{i} AS (SELECT feature, score FROM red{i} WHERE score > {EPS}),
score{i} AS (SELECT (SELECT avg(score) FROM top{i}) + (SELECT avg(score) FROM kept{i}) AS score),
sel{i} AS (SELECT feature, rid, bin FROM sel{p} UNION ALL SELECT feature, rid, bin FROM new{i}
  WHERE feature IN (SELECT feature FROM kept{i}))"""


def scores_of(i: int, tree_id: int = 1, join_idx: int = 0) -> str:
    """feature_scores rows of hop i."""
    return f"""SELECT {tree_id} AS tree_id, {join_idx} AS join_idx, feature, kind, score,
  feature IN (SELECT feature FROM kept{i}) AS selected FROM
  (SELECT feature, 'rel' AS kind, score FROM rel{i} UNION ALL SELECT feature, 'red', score FROM red{i})"""


HOP1 = f"{hop_start()}, {hop(1, 'customer', 'o_custkey', 'c_custkey')}"
SCORES1 = f"WITH {HOP1}, scores AS ({scores_of(1)})"
BASE_LIST = ", ".join(f"'orders__{c}'" for c, _ in ORDERS_FEATURES)


def chain(length: int = len(CHAIN)) -> str:
    """trees(tree_id, rank, features, join_keys, hops) and tree_joins of the grown chain."""
    CHAIN = ALL_OF_CHAIN[:length]
    hops = ", ".join(hop(i + 1, t2, c1, c2) for i, (_, t2, c1, c2) in enumerate(CHAIN))
    steps = []
    for i in range(1, len(CHAIN) + 1):
        keys = ",".join(f"{t1}__{c1},{t2}__{c2}" for t1, t2, c1, c2 in CHAIN[:i])
        features = " UNION ALL ".join(f"SELECT feature FROM kept{h}" for h in range(1, i + 1))
        steps.append(f"""SELECT {i} AS hop, score AS rank, (SELECT string_agg(feature, ',' ORDER BY feature) FROM
  (SELECT unnest([{BASE_LIST}]) AS feature UNION ALL {features})) AS features, '{keys}' AS join_keys
  FROM score{i} WHERE score IS NOT NULL""")
    base = ",".join(sorted(f"orders__{c}" for c, _ in ORDERS_FEATURES))
    links = ", ".join(f"({i}, '{t1}', '{t2}', '{c1}', '{c2}')" for i, (t1, t2, c1, c2) in enumerate(CHAIN))
    bridged = " UNION ALL ".join(f"SELECT {i - 1} AS join_idx, (SELECT count(*) FROM kept{i}) = 0 AS is_bridge, "
                                 f"(SELECT avg(CASE WHEN {c2} IS NULL THEN 0.0 ELSE 1.0 END) FROM rows{i}) AS ratio"
                                 for i, (_, _, _, c2) in enumerate(CHAIN, 1))
    return f"""WITH {hop_start()}, {hops},
trees AS (SELECT 0 AS tree_id, 0 AS hop, 0.0::DOUBLE AS rank, '{base}' AS features, '' AS join_keys UNION ALL
  SELECT CAST(row_number() OVER (ORDER BY hop) AS INT), hop, rank, features, join_keys FROM ({' UNION ALL '.join(steps)})),
links(join_idx, from_table, to_table, from_col, to_col) AS (VALUES {links}),
bridged AS ({bridged}),
tree_joins AS (SELECT tree_id, join_idx, from_table, to_table, from_col, to_col, ratio AS non_null_ratio, is_bridge
  FROM trees JOIN links ON join_idx < hop JOIN bridged USING (join_idx))"""


# -- results -------------------------------------------------------------------------

RULE_PARTS = " UNION ALL ".join(
    f"SELECT {t} AS tree_id, '{c}' AS feature, coalesce(CAST({short(c)} AS VARCHAR), '\x01') AS value, y AS label FROM j"
    for t, cs in RULES.items() for c in cs)
RULE = f"""WITH {JOINED}, l AS ({RULE_PARTS}),
p AS (SELECT *, CASE WHEN sum(label) OVER w * 2 > count(*) OVER w THEN 1 ELSE 0 END AS prediction
  FROM l WINDOW w AS (PARTITION BY feature, value)),
per AS (SELECT tree_id, feature, avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS accuracy,
  avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS plain FROM p GROUP BY 1, 2),
results AS (SELECT tree_id, 'RULE' AS model, 'majority rule' AS model_full_name, CAST(tree_id AS DOUBLE) AS rank,
  max(accuracy) AS accuracy FROM per GROUP BY tree_id),
importances AS (SELECT tree_id, 'RULE' AS model, feature, accuracy - plain AS importance FROM per)"""


def shown(selected: str, scores: str = "scores", ratio: str = "(SELECT avg(CASE WHEN c_custkey IS NULL THEN 0.0 ELSE 1.0 END) FROM rows1)") -> str:
    return f"""SELECT feature, {rnd(ratio, 'non_null_ratio')}, {rnd("max(CASE WHEN kind = 'rel' THEN score END)", 'rel')},
  {rnd("max(CASE WHEN kind = 'red' THEN score END)", 'red')} FROM {scores} WHERE {selected} GROUP BY feature"""


def edited(change: str) -> str:
    return f"(SELECT tree_id, join_idx, feature, kind, {change} AS score, selected FROM scores)"


def moved(features: list[str], flag: str, tree: str) -> str:
    return f"""{SCORES1} SELECT tree_id, join_idx, feature, kind, {rnd('score', 'score')},
  CASE WHEN feature IN ({listed(features)}) THEN {flag} ELSE selected END AS selected,
  coalesce((SELECT string_agg(feature, ',' ORDER BY feature) FROM ({tree})), '') AS tree_features FROM scores"""


def given(extra: str, drop: tuple[str, ...] = ()) -> str:
    names = ", ".join(f"{short(n)} AS {n}" for n in GIVEN if n not in drop)
    return f"""SELECT o_orderkey AS _rid, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS {TARGET}, {names} FROM orders
  LEFT JOIN {one('customer', 'c_custkey')} c ON o_custkey = c_custkey
  LEFT JOIN {one('nation', 'n_nationkey')} n ON c_nationkey = n_nationkey
  LEFT JOIN {one('region', 'r_regionkey')} r ON n_regionkey = r_regionkey{extra}"""


def table_rows(tables: list[str], counts: dict[str, int]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n_rows, CAST({counts[t]} AS BIGINT) AS n_cols FROM {t}" for t in tables)


N_COLS = {t: len(cols(t)) + (t == "embeddings") for t in ALL}


def survivors(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}__{c}' AS feature FROM {table} HAVING min({c}) < max({c})" for c, _ in cols(table))


def oracle_sql() -> dict[str, str]:
    q = {
        "a1_csv_scan": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
                       "strftime(o_orderdate, '%Y-%m-%d') AS o_orderday, o_orderpriority FROM orders",
        "a2_plain_scan": "SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels",
        "a3_qualified": "SELECT c_mktsegment, c_custkey AS customer__c_custkey, c_name AS customer__c_name, "
                        "c_nationkey AS customer__c_nationkey, c_acctbal AS customer__c_acctbal FROM customer",
        "a4_base_table": "SELECT c_custkey AS _rid, c_mktsegment, c_custkey AS customer__c_custkey, c_name AS customer__c_name, "
                         "c_nationkey AS customer__c_nationkey, c_acctbal AS customer__c_acctbal FROM customer",
        "a4_base_table_first": "SELECT c_custkey AS _rid, c_mktsegment, c_custkey AS customer__c_custkey, c_name AS customer__c_name, "
                               "c_nationkey AS customer__c_nationkey, c_acctbal AS customer__c_acctbal FROM customer",
        "a5_repository": f"SELECT name || '.parquet' AS name, n_rows, n_cols FROM ({table_rows(ALL, N_COLS)}) UNION ALL "
                         f"SELECT name, n_rows, n_cols FROM ({table_rows(['region'], N_COLS)})",
        "a6_tables": table_rows(ALL, N_COLS),
        "a7_add_table": near_edges(ALL),
        "a7_add_table_coma": f"WITH {composite_cte(ALL)}, {both('comp')} SELECT {EDGE_COLS} FROM edges",
        "b6_discovery_names": f"WITH {composite_cte(ALL)}, names AS (SELECT table1, col1, table2, col2, "
                              f"0.875 * name_score + 0.125 * type_score AS weight FROM comp), {both('names')} SELECT {EDGE_COLS} FROM edges",
        "a8_remove_table": on_edges(f"SELECT {EDGE_COLS} FROM edges WHERE from_table != 'part' AND to_table != 'part'"),
        "a9_edge_text": on_edges(f"SELECT {EDGE_COLS}, CAST(2 AS BIGINT) AS n_malformed FROM edges"),
        "a10_saved_edges": f"WITH {composite_cte(SAVED)}, {both('comp', 0.3)} SELECT {EDGE_COLS} FROM edges",
        "a11_partial_join": f"SELECT o_orderkey AS _rid, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS {TARGET}, "
                            "o_totalprice AS orders__o_totalprice, c_acctbal AS customer__c_acctbal, "
                            f"c_mktsegment AS customer__c_mktsegment FROM orders LEFT JOIN {one('customer', 'c_custkey')} c "
                            "ON o_custkey = c_custkey",
        "a12_links": on_edges("SELECT 'star/' || from_table AS from_table, 'star/' || to_table AS to_table, from_col, to_col, "
                              "1.0::DOUBLE AS weight FROM edges WHERE weight = 1"),
        "b1_table_pairs": f"WITH s AS ({table_rows(ALL, N_COLS)}) SELECT a.name AS table1, b.name AS table2, "
                          "a.n_rows AS rows1, b.n_rows AS rows2 FROM s a JOIN s b ON a.name < b.name",
        "b2_composite": f"WITH {composite_cte(ALL)} SELECT table1, col1, table2, col2, {rnd('name_score', 'name_score')}, "
                        f"{rnd('type_score', 'type_score')}, {rnd('inst_score', 'inst_score')}, {rnd('weight', 'weight')} FROM comp",
        "b3_jaccard": f"WITH {jaccard_cte(ALL)} SELECT table1, col1, table2, col2, {rnd('weight', 'weight')} FROM jac",
        "b3_near_jaccard": near_jaccard(),
        "b6_matcher_quality": matcher_quality(),
        "b4_threshold": f"WITH {jaccard_cte(ALL)} SELECT table1, col1, table2, col2, {rnd('weight', 'weight')} FROM jac WHERE weight > 0.5",
        "b5_both_directions": on_edges(f"SELECT {EDGE_COLS} FROM edges"),
        "b6_discovery": f"WITH {composite_cte(ALL)}, {both('comp')} SELECT {EDGE_COLS} FROM edges",
        "b6_discovery_jaccard": on_edges(f"SELECT {EDGE_COLS} FROM edges", ALL),
        "b7_edges_from": on_edges(f"SELECT {EDGE_COLS} FROM edges WHERE from_table = 'orders'"),
        "b8_edges_between": on_edges(f"SELECT {EDGE_COLS} FROM edges WHERE from_table = 'lineitem' AND to_table = 'orders'"),
        "b9_best_edges": on_edges(f"SELECT {EDGE_COLS} FROM edges QUALIFY row_number() OVER "
                                  "(PARTITION BY from_table, to_table ORDER BY weight DESC, from_col, to_col) = 1"),
        "b10_weight_matrix": on_edges(
            "SELECT from_table, " + ", ".join(rnd(f"max(CASE WHEN to_table = '{t}' THEN weight END)", t) for t in ALL)
            + " FROM (SELECT from_table, to_table, weight FROM edges UNION ALL "
            + " UNION ALL ".join(f"SELECT '{t}', '{t}', 1.0" for t in ALL) + ") GROUP BY from_table"),
        "b11_column_matrix": on_edges(
            "SELECT from_col, " + ", ".join(rnd(f"max(CASE WHEN to_col = '{c}' THEN weight END)", c) for c in
                                            ["o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"])
            + " FROM edges WHERE from_table = 'lineitem' AND to_table = 'orders' GROUP BY from_col"),
        "b12_edges_of_pair": on_edges(f"SELECT from_table AS from_label, to_table AS to_label, {EDGE_COLS} FROM edges "
                                      "WHERE from_table IN ('orders', 'lineitem') AND to_table IN ('orders', 'lineitem')"),
        "b13_add_edge": on_edges(f"SELECT {EDGE_COLS} FROM (SELECT * FROM edges UNION ALL "
                                 "SELECT 'orders', 'region', 'o_orderpriority', 'r_name', 0.25::DOUBLE UNION ALL "
                                 "SELECT 'region', 'orders', 'r_name', 'o_orderpriority', 0.25::DOUBLE)"),
        "b14_remove_edge": on_edges(f"SELECT {EDGE_COLS} FROM edges WHERE (from_table, from_col, to_table, to_col) NOT IN "
                                    "(('customer', 'c_custkey', 'orders', 'o_custkey'), ('orders', 'o_custkey', 'customer', 'c_custkey'))"),
        "b15_update_edge": on_edges("SELECT from_table, to_table, from_col, to_col, round(CASE WHEN (from_table, from_col, to_table, to_col) IN "
                                    "(('customer', 'c_custkey', 'orders', 'o_custkey'), ('orders', 'o_custkey', 'customer', 'c_custkey')) "
                                    "THEN 0.75::DOUBLE ELSE weight END, 6) AS weight FROM edges"),
        "b17_short_labels": "WITH d AS (SELECT doc_id, lang || '/' || source || '_' || doc_id || '.csv' AS f, lang, "
                            "source || '_' || doc_id || '.csv' AS n FROM documents) SELECT doc_id, CASE WHEN length(f) > 20 "
                            "THEN lang || '/' || substr(split_part(f, '/', 2), 1, 3) || '...' || right(split_part(f, '/', 2), 7) ELSE f END AS label FROM d",
        "c1_start": f"SELECT 0 AS tree_id, 'orders' AS begin, 0.0::DOUBLE AS rank, '{','.join(sorted('orders__' + c for c, _ in ORDERS_FEATURES))}' AS features, "
                    "count(*) AS n_rows, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM orders",
        "c2_join_trees": f"{chain()} SELECT tree_id, 'orders' AS begin, {rnd('rank', 'rank')}, features, join_keys FROM trees",
        "c2_target_edge": f"{chain()} SELECT tree_id, 'orders' AS begin, {rnd('rank', 'rank')}, features, join_keys FROM trees",
        "b16_cascade": f"{chain(2)} SELECT tree_id, join_idx, from_table, to_table, {rnd('non_null_ratio', 'non_null_ratio')} FROM tree_joins",
        "f3_algorithms": "SELECT m AS model, (SELECT count(*) FROM customer WHERE substr(md5(CAST(c_custkey AS VARCHAR)), 1, 2) < '33') AS n_test, "
                         "m != 'LR' AS reaches FROM (VALUES ('GBM'), ('KNN'), ('LR'), ('RF'), ('XGB'), ('XT')) v(m)",
        "f4_train": f"SELECT o_orderkey AS _rid, {IS_F} AS label, true AS predicted FROM orders "
                    "WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) < '33'",
        "f6_importance": "SELECT 1 AS tree_id, 'GBM' AS model, f AS feature, f = 'orders__hint' AS useful, f != 'orders__hint' AS idle FROM "
                         "(VALUES ('orders__o_totalprice'), ('orders__hint'), ('customer__c_acctbal')) v(f)",
        "f7_evaluate_trees": f"{chain()} SELECT tree_id, 'LR' AS model, {rnd('rank', 'rank')}, true AS reaches, "
                             "row_number() OVER (ORDER BY trees.rank DESC, tree_id) = 1 AS exact FROM trees",
        "f8_evaluate_tree": "SELECT 1 AS tree_id, 'GBM' AS model, 1.0::DOUBLE AS rank, true AS reaches",
        "c2_reachable": on_edges("SELECT t AS \"table\", CAST(min(d) AS INT) AS depth FROM r GROUP BY t", recursive=True,
                                 more=", r(t, d) AS (SELECT 'region', 0 UNION SELECT to_table, d + 1 FROM r JOIN edges ON from_table = t WHERE d < 14)"),
        "c3_neighbours": on_edges(f"SELECT {EDGE_COLS} FROM edges WHERE from_table IN (SELECT from_table FROM edges WHERE to_table = 'region')"),
        "c4_unvisited": on_edges("SELECT DISTINCT to_table AS \"table\" FROM edges WHERE to_table NOT IN (SELECT from_table FROM edges WHERE to_table = 'region')"),
        "c5_best_keys": on_edges(f"SELECT {EDGE_COLS} FROM edges QUALIFY rank() OVER (PARTITION BY from_table, to_table ORDER BY weight DESC) = 1"),
        "c6_type_check": f"WITH {composite_cte(ALL)} SELECT table1, col1, table2, col2 FROM comp WHERE weight > 0.4 AND type_score = 1",
        "c7_one_per_key": f"SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM {one('lineitem', 'l_orderkey')}",
        "c8_left_join": f"SELECT o_orderkey AS _rid, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS {TARGET}, "
                        "o_totalprice AS orders__o_totalprice, l_orderkey AS lineitem__l_orderkey, l_partkey AS lineitem__l_partkey, "
                        "l_quantity AS lineitem__l_quantity, l_returnflag AS lineitem__l_returnflag FROM orders "
                        f"LEFT JOIN {one('lineitem', 'l_orderkey')} l ON o_orderkey = l_orderkey",
        "c8_left_join_hot": "SELECT event_id AS events__event_id, user_id AS events__user_id, c_custkey AS customer__c_custkey, "
                            f"c_acctbal AS customer__c_acctbal FROM events LEFT JOIN {one('customer', 'c_custkey')} c ON user_id = c_custkey",
        "c9_ratio": f"WITH {ratios_cte()} SELECT from_table, from_col, to_table, to_col, {rnd('ratio', 'ratio')} FROM ratios",
        "c10_prune": f"WITH {ratios_cte()} SELECT from_table, from_col, to_table, to_col, {rnd('ratio', 'ratio')} FROM ratios WHERE ratio >= 0.5",
        "c11_new_features": " UNION ALL ".join(survivors(t) for t in ALL),
        "c12_hop": f"{SCORES1} SELECT tree_id, join_idx, feature, kind, {rnd('score', 'score')}, selected, "
                   "(SELECT round(score, 6) FROM score1) AS tree_score FROM scores",
        "c12_hop_lineitem": f"WITH {hop_start()}, {hop(1, 'lineitem', 'o_orderkey', 'l_orderkey')}, scores AS ({scores_of(1)}) "
                            f"SELECT tree_id, join_idx, feature, kind, {rnd('score', 'score')}, selected, "
                            "(SELECT round(score, 6) FROM score1) AS tree_score FROM scores",
        "c12_hop_text": f"WITH {hop_start('labels', 'doc_id', 'toxic', (('doc_id', 'integral'), ('quality', 'integral')))}, "
                        f"{hop(1, 'documents', 'doc_id', 'doc_id', prefix='documents_')}, scores AS ({scores_of(1)}) "
                        f"SELECT tree_id, join_idx, feature, kind, {rnd('score', 'score')}, selected, "
                        "(SELECT round(score, 6) FROM score1) AS tree_score FROM scores",
        "c13_tree_score": f"{SCORES1} SELECT 1 AS tree_id, 0 AS join_idx, {rnd('score', 'score')} FROM score1",
        "c14_kept_scores": f"{SCORES1} SELECT tree_id, join_idx, feature, kind, {rnd('score', 'score')}, selected FROM scores WHERE selected",
        "c15_tree_joins": f"{chain()} SELECT tree_id, join_idx, from_table, to_table, from_col, to_col, "
                          f"{rnd('non_null_ratio', 'non_null_ratio')}, is_bridge FROM tree_joins",
        "c16_bridge": f"WITH {hop_start()}, {hop(1, 'customer', 'o_custkey', 'c_custkey', k=1)} SELECT 'bridge' AS outcome, "
                      f"CAST({len(ORDERS_FEATURES)} AS BIGINT) AS n_features, feature, kind, {rnd('score', 'score')} FROM "
                      "(SELECT feature, 'rel' AS kind, score FROM rel1 UNION ALL SELECT feature, 'red', score FROM red1)",
        "c17_top_trees": f"{chain()} SELECT tree_id, {rnd('rank', 'rank')} FROM (SELECT * FROM trees ORDER BY rank DESC, tree_id LIMIT 2)",
        "c18_tree_by_id": f"{chain()} SELECT tree_id, 'orders' AS begin, {rnd('rank', 'rank')} FROM trees WHERE tree_id = 1",
        "c19_materialise": given(""),
        "c19_fan_out": "SELECT o_orderkey AS _rid, o_totalprice AS orders__o_totalprice, l_linenumber AS lineitem__l_linenumber, "
                       "l_extendedprice AS lineitem__l_extendedprice FROM orders LEFT JOIN lineitem ON o_orderkey IS NOT DISTINCT FROM l_orderkey",
        "c19_fan_out_hot": "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 2 THEN c_custkey END AS lk "
                           "FROM customer) LEFT JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 3 = 2 THEN s_suppkey END AS rk "
                           "FROM supplier) ON lk IS NOT DISTINCT FROM rk",
        "c20_remove_table": f"{chain()} SELECT tree_id, (SELECT string_agg(feature, ',' ORDER BY feature) FROM "
                            f"(SELECT unnest([{BASE_LIST}]) AS feature UNION ALL SELECT feature FROM kept1)) AS features, "
                            "CAST(2 AS BIGINT) AS n_keys, CAST(1 AS BIGINT) AS n_joins FROM trees WHERE tree_id = 2",
        "c21_tree_nodes": f"{chain()} SELECT tree_id, {rnd('rank', 'rank')}, CAST(join_idx AS INT) AS from_node, CAST(join_idx + 1 AS INT) AS to_node, "
                          "from_table, to_table, from_col || ' -> ' || to_col AS label FROM tree_joins JOIN trees USING (tree_id)",
        "c22_tree_summary": f"{chain()} SELECT tree_id, 'orders' AS begin, {rnd('rank', 'rank')}, join_idx, from_table, from_col, to_table, to_col, "
                            f"{rnd('non_null_ratio', 'non_null_ratio')} FROM trees JOIN tree_joins USING (tree_id) WHERE tree_id = 2",
        "d1_prepare": f"""SELECT o_orderkey AS _rid, CAST(o_orderkey AS DOUBLE) AS orders__o_orderkey, CAST(o_custkey AS DOUBLE) AS orders__o_custkey,
  {rnd('o_totalprice', 'orders__o_totalprice')}, {rnd('epoch_us(o_orderdate) / 1e6', 'orders__o_orderdate')},
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS orders__o_orderpriority,
  CAST(year(o_orderdate) AS DOUBLE) AS orders__o_orderdate__year, CAST(month(o_orderdate) AS DOUBLE) AS orders__o_orderdate__month,
  CAST(day(o_orderdate) AS DOUBLE) AS orders__o_orderdate__day, CAST(dayofweek(o_orderdate) + 1 AS DOUBLE) AS orders__o_orderdate__dayofweek
  FROM orders""",
        "d2_average_rank": f"WITH {JOINED}, {long_cte(NUMBERS)} SELECT feature, v AS value, n, "
                           "CAST(sum(n) OVER (PARTITION BY feature ORDER BY v) - n + (n + 1) / 2.0 AS DOUBLE) AS rank FROM "
                           "(SELECT feature, v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY 1, 2)",
        "d3_pearson": f"WITH {JOINED}, {long_cte(NUMBERS, extra=CONSTANT)} SELECT feature, {rnd(corr('v'), 'score')} FROM long WHERE v IS NOT NULL GROUP BY feature",
        "d4_spearman": f"WITH {JOINED}, {long_cte(NUMBERS[:1] + NUMBERS[2:], extra=CONSTANT)}, "
                       "p AS (SELECT feature, v, o_totalprice AS t FROM long JOIN j ON rid = o_orderkey WHERE v IS NOT NULL AND o_totalprice IS NOT NULL), "
                       "r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rx, "
                       "rank() OVER (PARTITION BY feature ORDER BY t) + (count(*) OVER (PARTITION BY feature, t) - 1) / 2.0 AS ry FROM p) "
                       f"SELECT feature, {rnd(corr('rx', 'ry'), 'score')} FROM r GROUP BY feature",
        "d4_spearman_binary": f"WITH {JOINED}, {long_cte(NUMBERS, extra=CONSTANT)}, {RANKS} SELECT feature, {rnd(corr('rk'), 'score')} FROM ranks GROUP BY feature",
        "d5_relevance": f"WITH {JOINED}, {long_cte(NUMBERS, extra=LEAK)}, {RANKS}, s AS (SELECT feature, round(abs({corr('rk')}), 12) AS score FROM ranks GROUP BY feature) "
                        f"SELECT feature, {rnd('score', 'score')}, score > {EPS} AND score < 1 - {EPS} AS selected FROM s UNION ALL SELECT 'nothing', 0.0::DOUBLE, false",
        "d5_relevance_pearson": f"WITH {JOINED}, {long_cte(NUMBERS, extra=LEAK)}, s AS (SELECT feature, round(abs({corr('v')}), 12) AS score FROM long WHERE v IS NOT NULL GROUP BY feature) "
                                f"SELECT feature, {rnd('score', 'score')}, score > {EPS} AND score < 1 - {EPS} AS selected FROM s",
        "d6_top_k": f"WITH {JOINED}, {long_cte(NUMBERS)}, {RANKS}, s AS (SELECT feature, round(abs({corr('rk')}), 12) AS score FROM ranks GROUP BY feature) "
                    f"SELECT feature, {rnd('score', 'score')}, true AS selected FROM (SELECT * FROM s WHERE score > {EPS} AND score < 1 - {EPS} ORDER BY score DESC, feature LIMIT 3)",
        "d7_relevance_plain": f"WITH {JOINED}, {long_cte(NUMBERS)}, {RANKS}, s AS (SELECT feature, round(abs({corr('rk')}), 12) AS score FROM ranks GROUP BY feature) "
                              f"SELECT feature, {rnd('score', 'score')} FROM s WHERE score > {EPS} AND score < 1 - {EPS}",
        "d8_bins": f"WITH {JOINED}, {long_cte(NUMBERS)}, {BINS} SELECT rid AS _rid, "
                   + ", ".join(f"CAST(max(CASE WHEN feature = '{n}' THEN bin END) AS INT) AS {n}" for n in NUMBERS) + " FROM bins GROUP BY rid",
        "d9_entropy": measures([(c, entropy(short(c))) for c in CODES + ["customer__c_mktsegment"]] + [(TARGET, entropy("y"))]),
        "d10_contingency": f"WITH {JOINED} SELECT CAST(n_regionkey AS BIGINT) AS x, CAST(y AS BIGINT) AS y, count(*) AS n FROM j GROUP BY 1, 2",
        "d11_conditional_entropy": measures([(c, f"{entropy(short(c), 'y')} - {entropy(short(c))}") for c in CODES]),
        "d12_mutual_information": measures([(c, mutual(short(c), "y")) for c in CODES]),
        "d13_conditional_information": measures([("a", conditional("o_custkey", "y", "n_regionkey")),
                                                 ("b", conditional("c_nationkey", "y", "o_orderpriority"))]),
        "d14_mrmr": f"{MRMR} SELECT feature, {rnd('score', 'score')} FROM mrmr",
        "d15_jmi": f"{MRMR}, gain AS (" + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, (" + " + ".join(conditional(short(s), short(f), "y") for s in CHOSEN) + f") / {len(CHOSEN)} AS g" for f in NEW)
            + f") SELECT feature, {rnd('score + g', 'score')} FROM mrmr JOIN gain USING (feature)",
        "d16_normalise": f"{MRMR}, n AS ({norm('mrmr')}) SELECT feature, {rnd('score', 'score')}, score > {EPS} AS selected FROM n",
        "d17_both": f"{MRMR}, lr AS (SELECT * FROM long WHERE feature IN ({listed(NEW)})), {RANKS.replace('FROM long', 'FROM lr')}, "
                    f"s AS (SELECT feature, round(abs({corr('rk')}), 12) AS score FROM ranks GROUP BY feature), n AS ({norm('mrmr')}) "
                    f"SELECT 'rel' AS kind, feature, {rnd('score', 'score')}, true AS selected FROM s WHERE score > {EPS} AND score < 1 - {EPS} "
                    f"UNION ALL SELECT 'red', feature, {rnd('score', 'score')}, score > {EPS} FROM n",
        "d18_cmim": f"WITH {JOINED}, raw AS (" + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, least({conditional(short(f), 'y', 'o_orderpriority')}, "
            f"{conditional(short(f), 'y', 'n_regionkey')}) AS score" for f in NEW[:2])
            + f"), n AS ({norm('raw')}) SELECT feature, {rnd('score', 'score')}, score > {EPS} AS selected FROM n",
        "d19_group_redundancy": f"WITH {JOINED}, raw AS (" + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, (" + " + ".join(conditional(short(f), "y", short(g)) for g in CODES if g != f) + ") / 2 AS score" for f in CODES)
            + f") SELECT feature, {rnd('score', 'score')}, score > {EPS} AS selected FROM raw",
        "d20_joint_information": f"{raw_mrmr(CODES[2:])}, n AS ({norm('raw')}) SELECT feature, {rnd('score', 'score')}, score > {EPS} AS selected FROM n",
        "e1_selected": f"{SCORES1} {shown('selected')}",
        "e2_discarded": f"{SCORES1} {shown('NOT selected')}",
        "e3_adjust_relevance": SCORES1 + " " + shown("selected", edited(
            "CASE WHEN feature = 'customer__c_acctbal' AND kind = 'rel' AND selected THEN 0.9 ELSE score END")),
        "e4_adjust_redundancy": SCORES1 + " " + shown("selected", edited(
            "CASE WHEN feature = 'customer__c_acctbal' AND kind = 'red' AND selected THEN 0.1 ELSE score END")),
        "e5_adjust_ratio": f"{SCORES1} {shown('selected', ratio='0.25::DOUBLE')}",
        "e6_discard": moved(["customer__c_acctbal", "customer__c_mktsegment"], "false",
                            "SELECT feature FROM kept1 WHERE feature NOT IN ('customer__c_acctbal', 'customer__c_mktsegment')"),
        "e7_select": moved(["customer__c_custkey"], "true", "SELECT feature FROM kept1 UNION SELECT 'customer__c_custkey'"),
        "f1_evaluation_table": given("", ("orders__o_custkey", "customer__c_nationkey")),
        "f2_split": "SELECT o_orderkey AS _rid, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) < '33' AS is_test FROM orders",
        "f5_accuracy": f"{RULE} SELECT {rnd('avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM p",
        "f9_best_result": f"{RULE} SELECT tree_id, model, model_full_name, {rnd('rank', 'rank')}, {rnd('accuracy', 'accuracy')} FROM results ORDER BY accuracy DESC, tree_id LIMIT 1",
        "f10_explain_result": f"{RULE} SELECT tree_id, model, {rnd('accuracy', 'accuracy')}, feature, {rnd('importance', 'importance')} "
                              "FROM results JOIN importances USING (tree_id, model) WHERE tree_id = 2",
        "f11_importance_by_table": f"{RULE} SELECT tree_id, model, feature, {rnd('importance', 'importance')} FROM importances WHERE contains(feature, 'customer')",
        "f12_importance_of": f"{RULE} SELECT tree_id, model, feature, {rnd('importance', 'importance')} FROM importances WHERE feature = 'nation__n_regionkey'",
        "f13_add_result": f"{RULE} SELECT tree_id, m AS model, model_full_name, {rnd('rank', 'rank')}, {rnd('accuracy', 'accuracy')} "
                          "FROM results CROSS JOIN (VALUES ('RULE'), ('RULE2')) v(m)",
    }
    q["d2_average_rank_ranges"] = q["d2_average_rank"]
    return q


def near_edges(tables: list[str]) -> str:
    """Edges of the near-equal matcher over some tables."""
    body = near_jaccard().replace(values_cte(ALL), values_cte(tables))
    ids_all = ", ".join(f"('{t}', '{c}', {i})" for i, (t, c) in enumerate((t, c) for t in sorted(ALL) for c, _ in cols(t)))
    ids_few = ", ".join(f"('{t}', '{c}', {i})" for i, (t, c) in enumerate((t, c) for t in sorted(tables) for c, _ in cols(t)))
    body = body.replace(ids_all, ids_few)
    return f"WITH pairs_ AS ({body}), {both('pairs_')} SELECT {EDGE_COLS} FROM edges"
