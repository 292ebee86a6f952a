"""The whole chain: sources -> mixture -> tokens -> split -> packed blocks, with every report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import RunConfig
from corpusloom.operators import packing, sampling, stats
from corpusloom.operators.tokenizers import BpeTokenizer, NativeTokenizer, append_eos
from corpusloom.shipping import ship_package
from corpusloom.sources import read_sources, read_split, write_json, write_mixture, write_packed, write_splits


def build_mixture(spark: SparkSession, config: RunConfig, root: str, out: str) -> None:
    """root/<source>/* -> out/data.parquet and out/data_distribution.json.

    Rows have no id; the sample's key is a digest of the text, and identical texts are interchangeable.
    """
    m = config.mixture
    rows = read_sources(spark, root, list(m.weights), m.exclude).withColumn("_key", F.sha2("text", 256))
    sampling.exact_sample(rows, m.weights, "_key", m.seed).drop("_key").write.mode("overwrite").partitionBy("dataset").parquet(f"{out}/data.parquet")
    written = spark.read.parquet(f"{out}/data.parquet")
    write_json(spark, stats.mixture_report(written, m.weights, m.seed), f"{out}/data_distribution.json")


def tokenize_and_split(spark: SparkSession, config: RunConfig, data: str, out: str) -> None:
    """A mixture -> out/split={train,test} and out/token_distribution.json (counted before the split)."""
    t = config.tokenize
    rows = spark.read.parquet(data)
    split = exact_split_of(rows, t.test_size, t.seed)  # on texts: tokens are made after it, once
    if t.tokenizer:
        ship_package(spark)
        encoder = BpeTokenizer.from_file(t.tokenizer)
        tokens = encoder.tokenize(append_eos(split, t.eos or encoder.eos))
    else:
        tokens = NativeTokenizer().tokenize(split)
    write_splits(tokens, out)
    written = spark.read.parquet(out).withColumn("num_tokens", F.size("input_ids").cast("long"))
    write_json(spark, stats.token_report(written), f"{out}/token_distribution.json")


def exact_split_of(rows: DataFrame, test_size: float, seed: int) -> DataFrame:
    """Rows without an id, split by a digest of their text; identical texts are interchangeable."""
    return sampling.threshold_split(rows.withColumn("order_key", F.sha2("text", 256)), test_size, "order_key", seed).drop("order_key")


def pack_split(spark: SparkSession, config: RunConfig, tokenized: str, out: str, split: str = "train") -> DataFrame:
    """One split -> out/<split> and out/packing_stats.json; packed in shuffle order."""
    length = config.pack.max_seq_length
    rows = read_split(spark, tokenized, split).withColumn("num_tokens", F.size("input_ids").cast("long"))
    bucket = F.substring("shuffle_key", 1, 4)
    write_packed(packing.pack(rows, length, "shuffle_key", bucket), f"{out}/{split}")
    report = stats.packing_report(packing.packing_stats(rows, length), length, tokenized, config.pack.eos_token_id)
    write_json(spark, report, f"{out}/packing_stats.json")
    return spark.read.parquet(f"{out}/{split}")


__all__ = ["build_mixture", "pack_split", "tokenize_and_split", "write_mixture"]
