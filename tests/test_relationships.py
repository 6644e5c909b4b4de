import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from joingrove.functions.naming import short_table_label
from joingrove import Augmenter
from joingrove.plans import jointree as JT
from joingrove.operators import edges as E, long_values as L, matchers as M
from joingrove.schemas import EDGES
from joingrove.sources import edge_files
from joingrove.sources.catalog import Catalog, read_links


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame([
        ("a", "b", "x", "y", 0.9), ("b", "a", "y", "x", 0.9),
        ("a", "b", "x", "z", 0.9), ("b", "a", "z", "x", 0.9),
        ("a", "c", "x", "w", 0.5), ("c", "a", "w", "x", 0.5),
        ("b", "c", "y", "w", 0.7), ("c", "b", "w", "y", 0.7)], EDGES)


def rows(df):
    return sorted(tuple(r) for r in df.select(*EDGES.names).collect())


def test_threshold_is_strict(edges):
    assert E.above(edges, 0.5).filter("weight <= 0.5").count() == 0
    assert E.above(edges, 0.5).count() == 6


def test_remove_then_add_restores(edges):
    less = E.remove_edge(edges, "c", "w", "b", "y")
    assert less.count() == 6
    assert rows(E.add_edge(less, "b", "y", "c", "w", 0.7)) == rows(edges)


def test_update_adds_where_absent(edges):
    assert E.update_edge(edges, "c", "w", "d", "v", 0.3).count() == 10
    got = E.update_edge(edges, "b", "y", "c", "w", 0.1)
    assert got.count() == 8 and got.filter("weight = 0.1").count() == 2


def test_negative_weight_is_refused(edges):
    with pytest.raises(ValueError):
        E.add_edge(edges, "a", "x", "b", "y", -0.1)


def test_best_keys_keep_ties(edges):
    assert len(JT.Links(JT.read_edges(edges)).best_keys("a", "b")) == 2
    assert E.best_edges(edges).filter("from_table = 'a' AND to_table = 'b'").first()["to_col"] == "y"


def test_matrix_has_ones_on_the_diagonal(edges):
    got = {r["from_table"]: r for r in E.weight_matrix(edges, ["a", "b", "c"]).collect()}
    assert all(got[t][t] == 1.0 for t in "abc") and got["a"]["c"] == 0.5


def test_reachable_depth(spark, edges):
    more = E.add_edge(edges, "c", "w", "d", "v", 0.6)
    assert JT.Links(JT.read_edges(more)).levels("a") == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_edge_text_round_trip(spark, edges, tmp_path):
    edge_files.write_edge_text(edges, str(tmp_path / "e"))
    found, malformed = edge_files.read_edge_text(spark, str(tmp_path / "e"))
    assert rows(found) == rows(edges) and malformed.count() == 0


def test_edge_text_reports_malformed_records(spark):
    text = spark.createDataFrame([("a--b--x--y--0.5,broken--record,a--b--x--y--notanumber,\n",)], "value string")
    good, bad = edge_files.parse_edge_text(text)
    assert rows(good) == [("a", "b", "x", "y", 0.5)] and bad.count() == 2


def test_saved_edges(spark, edges, tmp_path):
    path = edge_files.cache_path(str(tmp_path), "a", 0.5, "coma", ["a", "b"])
    assert edge_files.load_edges(spark, path) is None
    edge_files.save_edges(edges, path)
    assert rows(edge_files.load_edges(spark, path)) == rows(edges)
    assert path != edge_files.cache_path(str(tmp_path), "a", 0.5, "coma", ["a", "b", "c"])


def test_short_labels(spark):
    df = spark.createDataFrame([("credit/table_0_0.csv",), ("a_dataset/a_long_table_name.csv",), ("x" * 30,)], "t string")
    assert [r[0] for r in df.select(short_table_label(F.col("t"))).collect()] == [
        "credit/table_0_0.csv", "a_dataset/a_l...ame.csv", "xxx...xxxxxxx"]


@pytest.fixture(scope="module")
def repository(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repository")
    (root / "one").mkdir()
    (root / "two").mkdir()
    (root / "one" / "people.csv").write_text(
        'Key_0,name,born\n1,"Ann, the \\"first\\"",2001-02-03\n2,Bob,2001-02-04\n3,,2001-02-05\n')
    (root / "one" / "visits.csv").write_text("Key_0,place\n1,north\n1,south\n2,north\n")
    (root / "one" / "connections.csv").write_text("fk_table,fk_column,pk_table,pk_column\nvisits.csv,Key_0,people.csv,Key_0\n")
    spark.range(3).selectExpr("id AS other").write.parquet(str(root / "two" / "numbers.parquet"))
    return str(root)


def test_repository_needs_exactly_one_choice(spark, repository):
    with pytest.raises(ValueError):
        Catalog.from_repository(spark, repository)
    with pytest.raises(ValueError):
        Catalog.from_repository(spark, repository, ["one"], all_tables=True)


def test_repository_listing_and_csv(spark, repository):
    catalog = Catalog.from_repository(spark, repository, all_tables=True)
    assert catalog.names == ["one/people.csv", "one/visits.csv", "two/numbers.parquet"]
    people = catalog.table("one/people.csv")
    assert dict(people.dtypes)["born"] == "string" and dict(people.dtypes)["Key_0"] == "int"
    assert people.first()["name"] == 'Ann, the "first"'
    assert catalog.qualified("one/people.csv", "name").columns == [
        "name", "one/people.csv__Key_0", "one/people.csv__born"]
    assert {r["name"]: r["n_rows"] for r in catalog.tables().collect()}["one/visits.csv"] == 3
    assert read_links(spark, f"{repository}/one/connections.csv").first()["weight"] == 1.0


def test_schema_matcher_finds_equal_names(spark, repository):
    catalog = Catalog.from_repository(spark, repository, ["one"])
    found = M.find_relationships(catalog, 0.5, "coma").collect()
    assert {(r["from_table"], r["from_col"], r["weight"]) for r in found} == {
        ("one/people.csv", "Key_0", 1.0), ("one/visits.csv", "Key_0", 1.0)}


def test_unknown_matcher(spark, repository):
    with pytest.raises(ValueError):
        M.find_relationships(Catalog.from_repository(spark, repository, ["one"]), matcher="other")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    return distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)


def words(rnd, n, alphabet="ab1", longest=24):
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, longest))) for _ in range(n // 2)]
    out = set(base)
    while len(out) < n:
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(1, 4)):
            spot = rnd.randint(0, len(w))
            change = rnd.random()
            if change < 0.4:
                w.insert(spot, rnd.choice(alphabet))
            elif w and spot < len(w):
                if change < 0.7:
                    del w[spot]
                else:
                    w[spot] = rnd.choice(alphabet)
        if w:
            out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_matcher_against_brute_force(spark, tmp_path, seed):
    rnd = random.Random(seed)
    pool = words(rnd, 160)
    tables = {"t": sorted(rnd.sample(pool, 60)), "u": sorted(rnd.sample(pool, 80)),
              "v": [f"Customer#{i:07d}" for i in range(0, 60, 2)],
              "w": [f"Customer#{i:07d}" for i in range(1, 60, 7)] + [f"Supplier#{i:07d}" for i in range(20)]}
    catalog = Catalog(spark)
    for name, values in tables.items():
        path = str(tmp_path / name)
        spark.createDataFrame([(v,) for v in values], "c string").write.parquet(path)
        catalog = catalog.add(name, path)
    got = {(r["table1"], r["table2"]): r["weight"] for r in M.near_jaccard(catalog).collect()}
    names = sorted(tables)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            small, big = (a, b) if len(tables[a]) <= len(tables[b]) else (b, a)
            n = sum(any(near(x, y) for y in tables[big]) for x in tables[small])
            want = n / (len(tables[a]) + len(tables[b]) - n)
            assert got.get((a, b), 0.0) == pytest.approx(want), (a, b)


def letters(rnd, n):
    return "".join(rnd.choice("etaoin shrdlu") for _ in range(n))


def changed(rnd, text, share):
    """About `share` of the characters edited, a part of them in one place."""
    out, spot = list(text), rnd.randrange(len(text))
    for k in range(int(share * len(text))):
        at = min(spot + k, len(out) - 1) if k % 3 == 0 else rnd.randrange(len(out))
        change = rnd.random()
        if change < 0.4:
            out[at] = "x"
        elif change < 0.7:
            out.insert(at, rnd.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


def test_distance_and_its_bounds():
    rnd = random.Random(4)
    for _ in range(150):
        a = letters(rnd, rnd.choice([0, 1, 3, 40, 90]))
        b = changed(rnd, a, rnd.random() * 0.6) if a and rnd.random() < 0.8 else letters(rnd, rnd.choice([0, 5, 70]))
        d = distance(a, b)
        for limit in (0, 1, d - 1, d, d + 1, 40):
            if limit < 0:
                continue
            assert L.within(a, b, limit) == (d <= limit)
            for size in (3, 4):
                if d <= limit:
                    assert L.least_edits(L.Text(a), L.Text(b), size, limit) <= d
    assert L.within("𝔘é" * 50, "𝔘e" * 50, 50) and not L.within("𝔘é" * 50, "𝔘e" * 50, 49)


@pytest.mark.parametrize("blocks", [False, True])
def test_near_matcher_on_strings_of_any_length(spark, tmp_path, monkeypatch, blocks):
    rnd = random.Random(6)
    if blocks:  # many blocks of a few strings each
        monkeypatch.setattr(L, "LEFT_CHARS", 5000)
        monkeypatch.setattr(L, "RIGHT_CHARS", 6000)
    pool = [letters(rnd, rnd.choice([60, 64, 65, 66, 80, 200, 700])) for _ in range(30)]
    pool += [changed(rnd, rnd.choice(pool[:30]), rnd.choice([0.02, 0.1, 0.17, 0.2, 0.23, 0.3])) for _ in range(90)]
    pool = sorted(set(pool))
    tables = {"t": rnd.sample(pool, 40), "u": rnd.sample(pool, 50), "v": rnd.sample(pool, 30) + ["short", "shor"], "w": ["shorts", "x" * 100]}
    catalog = Catalog(spark)
    for name, values in tables.items():
        spark.createDataFrame([(v,) for v in values + [None]], "c string").write.parquet(str(tmp_path / name))
        catalog = catalog.add(name, str(tmp_path / name))
    got = {(r["table1"], r["table2"]): r["weight"] for r in M.near_jaccard(catalog).collect()}
    names = sorted(tables)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            small, big = (a, b) if len(tables[a]) <= len(tables[b]) else (b, a)
            n = sum(any(near(x, y) for y in tables[big]) for x in tables[small])
            assert got.get((a, b), 0.0) == pytest.approx(n / (len(tables[a]) + len(tables[b]) - n)), (a, b)
    alone = {(r["table1"], r["table2"]): r["weight"] for r in M.near_jaccard(catalog, table="u").collect()}
    assert alone == {k: v for k, v in got.items() if "u" in k}


def test_urls_of_one_host_by_rounds(spark, tmp_path, monkeypatch):
    """Values that share a long beginning, some near to many others and some to none."""
    rnd = random.Random(7)
    monkeypatch.setattr(M, "FIRST_SLICE", 16)
    monkeypatch.setattr(M, "SLICE_GROWTH", 3)
    url = lambda: "https://example.org/pages/" + "".join(rnd.choice("abcdefghijklmnop") for _ in range(12))
    tables = {"t": [url() for _ in range(150)], "u": [url() for _ in range(220)]}
    catalog = Catalog(spark)
    for name, values in tables.items():
        spark.createDataFrame([(v,) for v in values], "c string").write.parquet(str(tmp_path / name))
        catalog = catalog.add(name, str(tmp_path / name))
    n = sum(any(near(x, y) for y in tables["u"]) for x in tables["t"])
    assert 0 < n < 150 and M.near_jaccard(catalog).first()["weight"] == pytest.approx(n / (370 - n))


def test_long_values_meet_when_equal(spark, tmp_path):
    text = "long text " * 500
    catalog = Catalog(spark)
    for name, values in (("a", [text, "x"]), ("b", [text, text + "."])):
        spark.createDataFrame([(v,) for v in values], "c string").write.parquet(str(tmp_path / name))
        catalog = catalog.add(name, str(tmp_path / name))
    assert M.jaccard(catalog).first()["weight"] == pytest.approx(1 / 3)


def test_more_columns_than_one_bitmap_word(spark, tmp_path):
    catalog = Catalog(spark)
    for t in range(2):
        spark.range(10).selectExpr(*[f"id + {c + 5 * t} AS c{c}" for c in range(40)]).write.parquet(str(tmp_path / f"t{t}"))
        catalog = catalog.add(f"t{t}", str(tmp_path / f"t{t}"))
    got = {(r["col1"], r["col2"]): r["weight"] for r in M.jaccard(catalog).collect()}
    assert got[("c5", "c0")] == 1.0 and got[("c39", "c34")] == 1.0 and ("c0", "c30") not in got


def names_of(rnd, n):
    parts = ["cust", "order", "id", "key", "name", "date", "ship", "part", "price", "line", "no", "code", "x", "aaaa"]
    out = {rnd.choice(["_", "", "."]).join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n)}
    for w in list(out):
        w = list(w)
        w[rnd.randrange(len(w))] = rnd.choice(["z", "Q", "", "aa", "É"])
        out.add("".join(w))
    return sorted(out - {""})


@pytest.mark.parametrize("least", [1 / 3, 3 / 7, 4 / 7, 0.8])
def test_blocking_of_names_loses_no_pair(spark, least):
    names = names_of(random.Random(int(least * 100)), 120)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    both = df.withColumnRenamed("name", "n1").join(df.withColumnRenamed("name", "n2"), F.col("n1") < F.col("n2"))
    want = {(r["n1"], r["n2"]) for r in both.filter(f"{M._name_score('n1', 'n2')} > {least}").collect()}
    got = {tuple(r) for r in M.similar_names(df, least).collect()}
    assert want <= got and len(want) > 20
    assert least < 0.5 or len(got) < 0.7 * len(names) * (len(names) - 1) / 2
    assert M.similar_names(df, 0.33) is None


@pytest.mark.parametrize("instances", [False, True])
@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7])
def test_blocked_matcher_equals_all_pairs(spark, tmp_path, instances, threshold):
    rnd = random.Random(8)
    catalog = Catalog(spark)
    for t in range(4):
        own = rnd.sample(names_of(rnd, 12), 9)
        own = list({n.lower(): n for n in own}.values())
        spark.createDataFrame([tuple(rnd.randrange(4) if i % 2 else rnd.choice("abc") for i in range(len(own))) for _ in range(6)],
                              [n.replace(".", "") or "c" for n in {n.replace(".", "").lower(): n for n in own}.values()]
                              if len({n.replace(".", "").lower() for n in own}) == len(own) else [f"k{i}" for i in range(len(own))]
                              ).write.parquet(str(tmp_path / f"t{t}"))
        catalog = catalog.add(f"t{t}", str(tmp_path / f"t{t}"))
    key = lambda df: {tuple(r[c] for c in ("table1", "col1", "table2", "col2")): round(r["weight"], 9) for r in df.collect()}
    want = key(M.composite(catalog, instances).filter(F.col("weight") > threshold))
    assert key(M.composite(catalog, instances, above=threshold)) == want
    mine = key(M.composite(catalog, instances, "t1", threshold))
    assert mine == {k: w for k, w in want.items() if "t1" in (k[0], k[2])}


def test_many_columns_meet_few(spark):
    """20,000 names: what is compared is a small part of the 200 million pairs."""
    rnd = random.Random(1)
    syllables = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    names = {"_".join("".join(rnd.choice(syllables) for _ in range(2)) for _ in range(2)) for _ in range(20_000)}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert M.similar_names(df, 3 / 7).count() < len(names) ** 2 / 2 / 20


def test_saved_edges_are_not_served_for_other_tables(spark, tmp_path):
    for folder, far in (("one", 0), ("two", 50)):
        spark.range(100).selectExpr("id AS k").write.parquet(str(tmp_path / folder / "a"))
        spark.range(100).selectExpr(f"id + {far} AS j").write.parquet(str(tmp_path / folder / "b"))

    def weights(folder):
        catalog = Catalog(spark).add("a", str(tmp_path / folder / "a")).add("b", str(tmp_path / folder / "b"))
        session = Augmenter(spark, catalog=catalog, cache_root=str(tmp_path / "saved"))
        return {round(r["weight"], 6) for r in session.find_relationships("jaccard", 0.1).collect()}

    assert weights("one") == {1.0} and weights("two") == {round(50 / 150, 6)} and weights("one") == {1.0}
    spark.range(80).selectExpr("id AS j").write.mode("overwrite").parquet(str(tmp_path / "one" / "b"))
    assert weights("one") == {0.8}


def test_malformed_records_are_reported(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a--b--x--y--0.5,a--b--x--y,a--b--x--y--z,\n a--b--x--q--w--0.5,")
    session = Augmenter(spark, catalog=Catalog(spark))
    assert session.read_relationships(str(tmp_path / "e.txt")).count() == 1
    assert session.malformed_relationships.count() == 3


def test_known_links_name_tables_of_the_catalog(spark, tmp_path):
    lake = tmp_path / "lake" / "steel"
    lake.mkdir(parents=True)
    (lake / "a.csv").write_text("k,x\n1,2\n")
    (lake / "b.csv").write_text("k,z\n1,2\n")
    (lake / "connections.csv").write_text("fk_table,fk_column,pk_table,pk_column\na.csv,k,b.csv,k\na.csv,k,gone.csv,k\n")
    session = Augmenter(spark, root=str(tmp_path / "lake"))
    session.set_dataset_repository(["steel"])
    got = {tuple(r) for r in session.read_known_links("steel").collect()}
    assert got == {("steel/a.csv", "steel/b.csv", "k", "k", 1.0), ("steel/b.csv", "steel/a.csv", "k", "k", 1.0)}


def test_base_table_before_the_repository(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.csv").write_text("k,c\n1,0\n2,1\n")
    session = Augmenter(spark, root=str(tmp_path))
    session.set_base_table("x/t.csv", "c", row_key="k")
    session.set_dataset_repository(["y"])
    assert session.get_tables_repository() == ["x/t.csv", "y/t.csv"] and session.base_frame.count() == 2


def _sides(mine, theirs):
    return (pd.DataFrame({"md5": [f"x{i}" for i in range(len(mine))], "chars": mine, "w0": 1, "c0": ~2}),
            pd.DataFrame({"md5": [f"y{i}" for i in range(len(theirs))], "chars": theirs, "w0": 2}))


@pytest.mark.parametrize("letters", ["ab", "abcdefghij é", "abcdefghijklmnopqrstuvwxyzÄ𝔘"])
def test_long_strings_side_by_side_lose_no_near_pair(letters, monkeypatch):
    """Against the distance of every pair; all go through the words of a block, few at a time."""
    for name, value in {"FEW": 0, "SIDE_BY_SIDE": 64, "POOL": 200}.items():
        monkeypatch.setattr(L, name, value)
    rng = random.Random(7)
    mine = ["".join(rng.choice(letters) for _ in range(rng.randrange(66, 500))) for _ in range(14)]
    theirs = [changed(rng, rng.choice(mine), share) + "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
              for share in (0.02, 0.1, 0.15, 0.18, 0.2, 0.22, 0.3, 0.6) for _ in range(5)]
    alike = {f"x{i}" for i, a in enumerate(mine) for b in theirs
             if abs(len(a) - len(b)) <= int(0.2 * max(len(a), len(b)) + 1e-9) and L.within(a, b, int(0.2 * max(len(a), len(b)) + 1e-9))}
    found = L._compared(*_sides(mine, theirs), 1, 0.2, 64)
    assert 0 < len(alike) and set(found["md5"]) == alike and set(found["s0"]) == {2}


def test_unlike_long_strings_are_not_compared_one_by_one(monkeypatch):
    """Texts of the same syllables hold the same grams near the same places."""
    rng, calls = random.Random(3), []
    syllables = ["tion", "ing", "er ", "the ", "an", "sh", "ou ", "re", "ble", ". ", "ed ", "ha", "on"]
    texts = ["".join(rng.choice(syllables) for _ in range(600))[:1400] for _ in range(160)]
    one = L.near
    monkeypatch.setattr(L, "near", lambda *pair: calls.append(1) or one(*pair))
    texts[100] = changed(rng, texts[5], 0.14)
    assert L._compared(*_sides(texts[:80], texts[80:]), 1, 0.2, 64)["md5"].tolist() == ["x5"]
    assert 1 <= len(calls) <= 100  # of 6,400


def test_grams_that_fill_a_string_count_in_full():
    """More of one gram than two bytes can count."""
    mine, theirs = "a" * 200_000, "a" * 190_000 + "b"
    assert L._compared(*_sides([mine], [theirs]), 1, 0.2, 64)["md5"].tolist() == ["x0"]


def test_a_long_string_is_copied_a_few_times(spark, monkeypatch):
    """Rows that are sent to the tasks that compare, for strings of all lengths from 70 to 7,000."""
    texts = [f"{i:05d}" + "".join(chr(97 + (i * j) % 26) for j in range(65 + 7 * i)) for i in range(0, 1000, 5)]
    values = spark.createDataFrame([(t, 1 + i % 2, ~2 if i % 2 == 0 else -1) for i, t in enumerate(texts)], "chars string, w0 long, c0 long")
    monkeypatch.setattr(L, "_compared", lambda x, y, *rest: pd.DataFrame([[f"{uuid.uuid4()}", len(x) + len(y)]], columns=["md5", "s0"]))
    sent = L.near_long_columns(values, 1, 0.2, 64).agg({"s0": "sum"}).first()[0]
    assert sent <= 6 * len(texts)
