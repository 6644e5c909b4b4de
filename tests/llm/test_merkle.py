import hashlib
import zlib

import numpy as np
import pytest

from joingrove.llm import merkle
from tests.llm.conftest import plain


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(levels, i):
    found = []
    for row in levels[:-1]:
        start = i // 8 * 8
        found += [row[j] for j in range(start, min(start + 8, len(row))) if j != i]
        i //= 8
    return found


def folded(levels, i, leaf):
    for row in levels[:-1]:
        start = i // 8 * 8
        run = row[start:start + 8]
        run[i - start] = leaf
        leaf, i = H(*run), i // 8
    return leaf


def slow_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, H(*map(field, r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    over = levels_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            other = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                other = H(*map(field, r[:4]), field(low))
            root = over[-1][0]
            got = folded(over, k, folded(trees[g], i, other))
            out.append({"doc_id": r[0], "leaf": leaf, "subroot": trees[g][-1][0], "root": root, "folded_root": got,
                        "proof_sha256": H(*siblings(trees[g], i), *siblings(over, k)), "verified": got == root})
    return out


def test_hash_states_equal_the_library():
    rng = np.random.default_rng(3)
    for blocks in (1, 2, 8):
        nodes = rng.integers(0, 1 << 32, (8, 5000 * blocks), dtype=np.uint32)
        first = np.arange(5000) * blocks
        got, before = merkle.parents(nodes, first, np.full(5000, blocks))
        raw, tops = merkle._to_bytes(nodes), merkle._to_bytes(got)
        for i in (0, 1, 4095, 4096, 4999):
            text = b"".join(raw[j * 32:j * 32 + 32].hex().encode() for j in range(i * blocks, (i + 1) * blocks))
            assert tops[i * 32:i * 32 + 32] == hashlib.sha256(text).digest()
        # each kept state, resumed with what stands to its right, gives the same digest
        for slot in range(blocks):
            again = merkle.fold(nodes[:, first + slot], before[:, :, slot], np.full(5000, slot), np.full(5000, blocks),
                                lambda k, here: nodes[:, first[here] + slot + k])
            assert (again == got).all()


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9, 1], [64, 65, 1], [512, 7], [513, 3, 1, 1, 2, 2, 2, 2, 5], [4097, 600, 1]])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(1000 * g + i * 3 % 997 + i // 997, "s", f"l{g}", i % 50, f"Text {i} of {g} ÄZ")
            for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = plain(merkle.manifest(df))
    assert got == sorted(slow_manifest(rows), key=lambda d: repr(sorted(d.items())))
    assert any(not r["verified"] for r in got) or len(rows) < 9


def test_odd_rows(spark, odd_docs):
    df = odd_docs.selectExpr("*", "CASE WHEN doc_id < 4 THEN 'é' WHEN doc_id > 5 THEN 'zz' END AS lang", "length(text) AS n_chars",
                             "1 AS idx", "2 AS g", "3 AS at", "4 AS digest")
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert plain(merkle.manifest(df)) == sorted(slow_manifest(rows), key=lambda d: repr(sorted(d.items())))
    assert merkle.manifest(df.limit(0)).count() == 0


def test_many_equal_rows_and_groups(spark):
    rows = [(7, "s", "a", 1, "Same")] * 700 + [(i, "s", f"g{i % 90}", 1, "X") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert plain(merkle.manifest(df)) == sorted(slow_manifest(rows), key=lambda d: repr(sorted(d.items())))
