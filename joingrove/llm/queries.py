"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joingrove.llm import decontam, editprint, licences, merkle, packing, pii, quality, shards, simhash, superminhash, toxicity, warc, whitening
from joingrove.llm.common import table


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan(table(spark, sf, "documents"))


def op2_sampled_splitters(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shards.size_of("text").alias("size"),
                        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64("text").alias("text_key"))
    return (shards.shard_by_size(light, "size", ["text_key", "doc_id"], 16)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def op3_edit_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return editprint.fingerprint_pairs(table(spark, sf, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def op6_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return (simhash.near_duplicates(table(spark, sf, "documents"))
            .select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id"))


def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.spans(table(spark, sf, "documents"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    return (warc.round_trip(table(spark, sf, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return (decontam.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
            .select("doc_id", "item_id", "start_word", "n_words", "distance", "similarity"))


def op11_superminhash(spark: SparkSession, sf: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(table(spark, sf, "documents"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_license_scan, op2_sampled_splitters, op3_edit_embedding, op4_best_fit_packing, op5_toxicity,
        op6_simhash_near_dedup, op7_pii, op8_quality, op9_warc, op10_decontaminate,
        op11_superminhash, op12_merkle_manifest, op13_whitening, pipeline)}


#: The SHA-1 in base32: five hexadecimal digits are twenty bits, and those are four letters.
_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h FROM p),
b AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
      max(page_id) OVER (PARTITION BY h) AS lead FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM b
"""


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, m FROM r JOIN ways ON x = d)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT d AS doc_id, min(m) AS component_id FROM r GROUP BY d) LEFT JOIN n USING (doc_id)
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _digest(text: str) -> str:
    return f"sha256({' || '.join(f'({_field(c)})' for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

#: Trees of the groups and of their subroots, with the same three steps: levels, siblings, folding.
_OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_digest("text")} AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN {_digest(_LOWER.format("text"))} ELSE {_digest("text")} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t(g, l, i, h, n) AS (SELECT g, 0, i, leaf, count(*) OVER (PARTITION BY g) FROM p
  UNION ALL SELECT g, l + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM t WHERE n > 1 GROUP BY g, l, i // 8),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i FROM t WHERE n = 1),
u(l, i, h, n) AS (SELECT 0, i, h, count(*) OVER () FROM sub
  UNION ALL SELECT l + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM u WHERE n > 1 GROUP BY l, i // 8),
f(g, i, l, h) AS (SELECT g, i, 0, other FROM p
  UNION ALL SELECT f.g, f.i, f.l + 1, sha256(string_agg(CASE WHEN t.i = f.i >> (3 * f.l) THEN f.h ELSE t.h END, '' ORDER BY t.i))
  FROM f JOIN t ON t.g = f.g AND t.l = f.l AND t.n > 1 AND t.i >> 3 = f.i >> (3 * f.l + 3) GROUP BY f.g, f.i, f.l),
v(g, i, k, l, h) AS (SELECT g, f.i, sub.i, 0, arg_max(f.h, f.l) FROM f JOIN sub USING (g) GROUP BY 1, 2, 3
  UNION ALL SELECT v.g, v.i, v.k, v.l + 1, sha256(string_agg(CASE WHEN u.i = v.k >> (3 * v.l) THEN v.h ELSE u.h END, '' ORDER BY u.i))
  FROM v JOIN u ON u.l = v.l AND u.n > 1 AND u.i >> 3 = v.k >> (3 * v.l + 3) GROUP BY v.g, v.i, v.k, v.l),
below AS (SELECT p.g, p.i, string_agg(t.h, '' ORDER BY t.l, t.i) AS s FROM p JOIN t ON t.g = p.g AND t.n > 1
  AND t.i >> 3 = p.i >> (3 * t.l + 3) AND t.i != p.i >> (3 * t.l) GROUP BY p.g, p.i),
above AS (SELECT sub.g, string_agg(u.h, '' ORDER BY u.l, u.i) AS s FROM sub JOIN u ON u.n > 1
  AND u.i >> 3 = sub.i >> (3 * u.l + 3) AND u.i != sub.i >> (3 * u.l) GROUP BY sub.g),
fin AS (SELECT g, i, arg_max(h, l) AS folded_root FROM v GROUP BY g, i)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(below.s, '') || coalesce(above.s, '')) AS proof_sha256,
  folded_root, folded_root = root.h AS verified
FROM p JOIN sub USING (g) JOIN fin ON fin.g = p.g AND fin.i = p.i CROSS JOIN (SELECT h FROM u WHERE n = 1) root
LEFT JOIN below ON below.g = p.g AND below.i = p.i LEFT JOIN above ON above.g = p.g
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can state the operator; the other queries are held against brute force in tests/llm."""
    return {"op9_warc": _OP9, "op11_superminhash": _OP11, "op12_merkle_manifest": _OP12}
