"""Sinks. Tables are written by the executors; reports of a few rows are written through Hadoop's file system."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schemas import PART_BLOCKS


def write_mixture(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("dataset").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split; the helper column num_tokens goes."""
    df.drop("num_tokens").write.mode("overwrite").partitionBy("split").parquet(path)


def replace_splits(df: DataFrame, path: str) -> None:
    """The splits that df has are written anew, all others in path stay as they are; the helper column num_tokens goes."""
    df.drop("num_tokens").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)


def write_packed(df: DataFrame, path: str, rows: int = PART_BLOCKS) -> None:
    """Packed blocks in folders part=<seq // rows>, sorted by seq, so that a reader of some blocks opens their folders alone."""
    parts = df.select("seq", "input_ids", F.floor(F.col("seq") / rows).alias("part"))
    parts.repartitionByRange("seq").sortWithinPartitions("part", "seq").write.mode("overwrite").partitionBy("part").parquet(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()


def write_report(report: DataFrame, path: str) -> None:
    """A report's one row as an indented JSON file; fields that are null are left out."""
    write_json(report.sparkSession, json.loads(report.select(F.to_json(F.struct(*report.columns))).first()[0]), path)


def append_metrics(df: DataFrame, path: str, run: str) -> None:
    """Wide metric rows (step and any numeric columns) appended as (run, step, metric, value)."""
    names = [c for c in df.columns if c != "step"]
    long = df.select("step", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias("metric", "value"))
    long.where("value IS NOT NULL").select(F.lit(run).alias("run"), "step", "metric", "value").write.mode("append").partitionBy("run").parquet(path)


def write_eval_results(spark: SparkSession, results: list[dict], folder: str) -> list[str]:
    """One file per task and step; nothing is written for no results."""
    paths = []
    for r in results:
        paths.append(f"{folder}/{r['task_name']}_step{r['step']}.json")
        write_json(spark, {"step": r["step"], "metrics": r["metrics"], "num_samples": r["num_samples"]}, paths[-1])
    return paths


def write_config(spark: SparkSession, config: dict, folder: str) -> str:
    """folder/config.yaml: the resolved configuration, as JSON, which YAML readers read."""
    write_json(spark, config, f"{folder}/config.yaml")
    return f"{folder}/config.yaml"


#: Bytes of a merged file, as its parts have them: one scan task's, so that a task's share doesn't follow the source's size.
MERGED_BYTES = 128 << 20


def write_one_file(spark: SparkSession, paths: list[str], path: str, target: int = MERGED_BYTES) -> None:
    """The rows of many Parquet files in a folder with as few part files as target allows: one for a small source.

    Files are only put together, not shuffled; each task streams about target bytes of them.
    """
    conf, size = spark._jsc.hadoopConfiguration(), 0
    for x in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(x)
        size += p.getFileSystem(conf).getContentSummary(p).getLength()
    spark.read.parquet(*paths).coalesce(max(1, -(-size // target))).write.mode("overwrite").parquet(path)
