"""Declared schemas of every stage, and checks at the stage boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW = T.StructType([T.StructField("text", T.StringType())])
MIXED = T.StructType([T.StructField("text", T.StringType()), T.StructField("dataset", T.StringType())])
TOKENIZED = T.StructType(
    [
        *MIXED.fields,
        T.StructField("input_ids", T.ArrayType(T.LongType())),
        T.StructField("num_tokens", T.LongType()),
    ]
)
PACKED = T.StructType([T.StructField("seq", T.LongType()), T.StructField("input_ids", T.ArrayType(T.LongType()))])
#: Blocks of one folder of a packed table.
PART_BLOCKS = 8192
CHECKPOINTS = T.StructType(
    [
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("step", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)


class SchemaError(ValueError):
    """A stage got a table without a column that it needs."""


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df itself; raises SchemaError, before any job runs, if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns {missing}; there are {df.columns}")
    return df
