"""A corpus pipeline: each stage applies one operator of joingrove.llm to all that the stage before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; what one returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joingrove.llm import decontam, packing, pii, simhash, toxicity
from joingrove.llm.common import stage, table
from joingrove.sources.staging import discard


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like any other."""
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.toxic(F.col("text"), network, spark))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Near means what the operator's contract says: fingerprints of three-word shingles that differ in at most three bits,
    or are joined by a chain of such. One word replaced in a hundred often changes more bits than that, so exact and
    almost exact copies go and looser ones stay; the README has the measured share.
    """
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; those with null or empty texts stay."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the text. A null text stays null."""
    hidden = docs.withColumn("text", pii.redacted(F.col("text"), spark))
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences; a null text is packed as an empty one."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", one_of_near_copies), ("benchmark decontamination", drop_leaks),
          ("pii", hide_personal_data), ("best-fit packing", pack_sequences)]

#: The stages cannot be stated in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before is not None:  # written once more and read no more
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
