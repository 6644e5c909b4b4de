"""Schemas of the small result tables a session keeps."""

from pyspark.sql import types as T

EDGES = T.StructType([
    T.StructField("from_table", T.StringType()),
    T.StructField("to_table", T.StringType()),
    T.StructField("from_col", T.StringType()),
    T.StructField("to_col", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])

TREES = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("begin", T.StringType()),
    T.StructField("rank", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("join_keys", T.ArrayType(T.StringType())),
])

TREE_JOINS = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("join_idx", T.IntegerType()),
    T.StructField("from_table", T.StringType()),
    T.StructField("to_table", T.StringType()),
    T.StructField("from_col", T.StringType()),
    T.StructField("to_col", T.StringType()),
    T.StructField("non_null_ratio", T.DoubleType()),
    T.StructField("is_bridge", T.BooleanType()),
])

FEATURE_SCORES = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("join_idx", T.IntegerType()),
    T.StructField("feature", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("selected", T.BooleanType()),
])

RESULTS = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("model_full_name", T.StringType()),
    T.StructField("rank", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
])

IMPORTANCES = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("importance", T.DoubleType()),
])
