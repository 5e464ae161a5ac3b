"""Logical schemas of the engine."""

from pyspark.sql import types as T

# Blocks are laid out in this order; the label always takes the last column.
USER = "user"
ITEM = "item"
NUMERICAL = "context_numerical"
CATEGORICAL = "context_categorical"
CATEGORICAL_SET = "context_categorical_set"
LABEL = "label"

CELLS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("col", T.LongType()),
    T.StructField("cat", T.StringType()),
    T.StructField("val", T.DoubleType()),
])

FACTORS = T.StructType([
    T.StructField("col", T.LongType()),
    T.StructField("v", T.DoubleType()),
    T.StructField("m", T.ArrayType(T.DoubleType())),
])

BLOCKS = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("begin", T.LongType()),
    T.StructField("end", T.LongType()),
])

HEADER = T.StructType([
    T.StructField("c", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("num_attribute", T.LongType()),
    T.StructField("num_factor", T.IntegerType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
])

REGISTRY = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("created", T.LongType()),
])

SIMILARS_JSON = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("col", T.LongType()),
        T.StructField("items", T.ArrayType(T.StructType([
            T.StructField("col", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]))),
    ]))),
])
