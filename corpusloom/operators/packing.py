"""Packing: the concatenation of all token arrays in key order, cut every length tokens; never padded or truncated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import key_bucket, prefix_sum


def _checked(length: int) -> int:
    if length < 1:
        raise ValueError("block length must be at least 1")
    return length


def doc_spans(df: DataFrame, length: int, key: str, bucket: Column | None = None, count: str = "num_tokens") -> DataFrame:
    """df's rows once per block that they touch, with seq, block_offset, doc_offset and n of each piece.

    A row without tokens touches no block.
    """
    _checked(length)
    placed = prefix_sum(df, F.col(count), [key], key_bucket(key) if bucket is None else bucket)
    first, last = F.floor(F.col("offset") / length), F.floor((F.col("offset") + F.col(count) - 1) / length)
    return (
        placed.where(F.col(count) > 0)
        .withColumn("seq", F.explode(F.sequence(first, last)))
        .withColumn("_from", F.greatest(F.col("offset"), F.col("seq") * length))
        .withColumn("_to", F.least(F.col("offset") + F.col(count), (F.col("seq") + 1) * length))
        .withColumn("block_offset", F.col("_from") - F.col("seq") * length)
        .withColumn("doc_offset", F.col("_from") - F.col("offset"))
        .withColumn("n", F.col("_to") - F.col("_from"))
        .drop("_from", "_to", "offset")
    )


def pack(df: DataFrame, length: int, key: str, bucket: Column | None = None) -> DataFrame:
    """(seq, input_ids, n_docs): blocks of length tokens, the last one as long as what is left.

    Each document is cut into the pieces that blocks need before the shuffle, so a block's group holds length tokens at
    most, however long a document is.
    """
    pieces = doc_spans(df, length, key, bucket).select(
        "seq", "block_offset", F.slice("input_ids", (F.col("doc_offset") + 1).cast("int"), F.col("n").cast("int")).alias("piece")
    )
    return pieces.groupBy("seq").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_offset", "piece"))), lambda p: p["piece"])).alias("input_ids"),
        F.count(F.lit(1)).alias("n_docs"),
    )


def packing_stats(df: DataFrame, length: int, count: str = "num_tokens") -> DataFrame:
    """One row of totals; both averages are 0 when there is no block. Rows without tokens count as examples."""
    _checked(length)
    total = df.agg(F.coalesce(F.sum(count), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("num_examples"))
    seqs = F.ceil(F.col("total_tokens") / length)
    avg = lambda c: F.when(seqs > 0, F.col(c) / F.greatest(seqs, F.lit(1))).otherwise(F.lit(0.0))
    return total.select(
        seqs.alias("total_sequences"), "total_tokens", "num_examples", avg("total_tokens").alias("avg_tokens_per_sequence"), avg("num_examples").alias("avg_examples_per_sequence")
    )
