import corpus_pipeline
from joingrove.llm import pii, toxicity
from tests.llm.test_decontam import brute as leaks_by_brute_force
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute as groups_by_brute_force

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_run_equals_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    net = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {i: t for i, t in docs.items() if net.score([toxicity.word_places(t)])[0] < 0.5}
    groups = groups_by_brute_force(docs)
    docs = {i: t for i, t in docs.items() if groups[i][1] == i}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    suspects = {i: t for i, t in docs.items() if any(x[:15].lower() in t.lower() for x in items.values())}
    leaked = {d for d, _ in leaks_by_brute_force(suspects, items)}
    docs = {i: pii.redact(t) for i, t in docs.items() if i not in leaked}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 100 < len(docs) < 200
    check(rows, docs)


def test_odd_rows(spark, odd_docs, no_docs):
    """All columns stay through the stages, clashing names included, and the rows are those that should stay."""
    odd = odd_docs.selectExpr("*", "1 AS d", "2 AS item", "3 AS component_id", "'q' AS _own_id")
    for docs in (odd, no_docs):
        rows = docs
        for _, function in corpus_pipeline.STAGES[:-1]:
            rows = function(spark, rows, SF)
            assert rows.columns == docs.columns
        kept = rows.collect()
        if docs is odd:
            assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 2, 4, 6, 8]
            assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id here at all"]
            assert all((r["d"], r["item"], r["component_id"], r["_own_id"], r["key"]) == (1, 2, 3, "q", "k") for r in kept)
        pieces = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
        assert len({r["doc_id"] for r in pieces}) == len({r["doc_id"] for r in kept})
