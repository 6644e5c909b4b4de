"""Written intermediates. They survive the loss of any executor and cut the
lineage of a long chain of joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates, as the session names it in `spark.checkpoint.dir`.

    A session in local mode that names none gets the folder `checkpoints` of its
    warehouse; on a cluster the setting must be there.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


def discard(df: DataFrame) -> None:
    """Removes the files of a staged frame that nothing reads any more."""
    spark = df.sparkSession
    ours = f"{staging_root(spark)}/joingrove/".removeprefix("file://")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if ours in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/joingrove/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and go on from the written columns."""
    return stage_observed(df, label)[0]


def stage_observed(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """As `stage`; `metrics`, named aggregates, are read off the rows on their
    way to the files, so they cost no pass of their own."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if not metrics:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), {}
    seen = Observation()
    df.observe(seen, *metrics).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get
