"""Local and remote file sources: one directory per source, Parquet and JSON lines side by side."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas
from corpusloom.functions import source_of_path


class MissingSourceError(ValueError):
    """A mixture names a source that is not there."""


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """What a glob finds, by Hadoop's file system: works for any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(x.getPath().toString() for x in found or [])


def list_files(spark: SparkSession, root: str, suffix: str = ".parquet") -> list[str]:
    """The paths below root, at any depth, that end with suffix, in order; relative to root."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found, base, files = fs.listFiles(p, True), fs.makeQualified(p).toString().rstrip("/") + "/", []
    while found.hasNext():
        name = found.next().getPath().toString().removeprefix(base)
        if name.endswith(suffix) and not any(x.startswith(("_", ".")) for x in name.split("/")):
            files.append(name)
    return sorted(files)


def files_by_folder(spark: SparkSession, root: str, suffix: str = ".parquet") -> dict[str, list[str]]:
    """The files below root by the first part of their path; a file that lies in root itself is its own group."""
    by: dict[str, list[str]] = {}
    for f in list_files(spark, root, suffix):
        by.setdefault(f.split("/", 1)[0], []).append(f"{root}/{f}")
    return by


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as it is."""
    return spark.read.text(path, wholetext=True).head()[0]


def file_manifest(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(dataset, path) of root/<source>/*.{jsonl,parquet}, without paths that contain a string of exclude."""
    found = _paths(spark, f"{root}/*/*.jsonl") + _paths(spark, f"{root}/*/*.parquet")
    df = spark.createDataFrame([(p,) for p in found], "path string")
    for x in exclude:
        df = df.where(~F.col("path").contains(x))
    return df.select(source_of_path(F.col("path")).alias("dataset"), "path")


def read_source(spark: SparkSession, paths: Iterable[str], dataset: str) -> DataFrame:
    """(text, dataset) of one source's files; only text is read of either format."""
    paths = list(paths)
    lines, parquet = [p for p in paths if p.endswith(".jsonl")], [p for p in paths if not p.endswith(".jsonl")]
    parts = []
    if lines:
        parts.append(spark.read.schema(schemas.RAW).json(lines))
    if parquet:
        parts.append(schemas.require(spark.read.parquet(*parquet), "text").select("text"))
    if not parts:
        raise MissingSourceError(f"no file for {dataset}")
    return reduce(DataFrame.unionByName, parts).withColumn("dataset", F.lit(dataset))


def check_sources(names: Iterable[str], available: Iterable[str]) -> None:
    """Raises before anything is read if a name is not available."""
    available = sorted(set(available))
    if missing := [n for n in names if n not in available]:
        raise MissingSourceError(f"missing sources {missing}; available: {available}")


def read_sources(spark: SparkSession, root: str, names: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Union of the named sources under root; others are ignored, a missing one raises."""
    by: dict[str, list[str]] = {}
    for r in file_manifest(spark, root, exclude).toLocalIterator():  # file names alone
        by.setdefault(r["dataset"], []).append(r["path"])
    check_sources(names, by)
    return reduce(DataFrame.unionByName, [read_source(spark, by[n], n) for n in names])


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A table written by write_splits(); one split prunes the others' folders."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split).drop("split")


def read_packed(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, rows: int = schemas.PART_BLOCKS) -> DataFrame:
    """(seq, input_ids) that write_packed() wrote with rows, or its blocks from first to before last, in order.

    Folders that hold none of them are not opened; within the rest, files tell their least and greatest seq.
    """
    df = spark.read.schema(T.StructType([*schemas.PACKED.fields, T.StructField("part", T.LongType())])).parquet(path)
    if first is not None:
        df = df.where((F.col("part") >= first // rows) & (F.col("seq") >= first))
    if last is not None:
        df = df.where((F.col("part") <= max(last - 1, 0) // rows) & (F.col("seq") < last))
    got = df.select("seq", "input_ids")
    return got if first is None and last is None else got.orderBy("seq")


def read_token_report(spark: SparkSession, path: str) -> dict | None:
    """The token report, with defaults for absent fields; None if there is no such file."""
    if not _paths(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).head(1)
    got = json.loads(rows[0][0])
    return {"total_tokens": 0, "tokens_per_source": {}, "percentages": {}} | got


def scan_report(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON reports as rows, one per file, with declared types: maps stay maps, absent fields are null."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def file_table(spark: SparkSession, root: str, pattern: str = "*", digest: bool = True) -> DataFrame:
    """(path, dataset, bytes, modified, sha256) of the files below root whose names match pattern, by a scan.

    path is relative to root and dataset its first part. Files are read, for their digest, by the executors; without it only
    their listing is. A digest takes a whole file in memory: leave it out for files of gigabytes.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.substring("path", len(base) + 1, 1 << 30)
    sha = F.sha2("content", 256) if digest else F.lit(None).cast("string")
    return files.select(path.alias("path"), F.substring_index(path, "/", 1).alias("dataset"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), sha.alias("sha256"))


def dataset_manifest(files: DataFrame) -> DataFrame:
    """(dataset, n_files, bytes, digest) of a file_table(): digest is that of a dataset's file digests, whatever their names."""
    digests = F.array_join(F.array_sort(F.collect_list("sha256")), "")
    return files.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.sha2(digests, 256).alias("digest"))


def manifest_difference(old: DataFrame, new: DataFrame, key: str = "dataset", digest: str = "digest") -> DataFrame:
    """(key, status, old_bytes, new_bytes): what is new, gone, changed (in size or digest) or the same in new."""
    a = old.select(key, F.col("bytes").alias("old_bytes"), F.col(digest).alias("_old"))
    b = new.select(key, F.col("bytes").alias("new_bytes"), F.col(digest).alias("_new"))
    same = (F.col("old_bytes") == F.col("new_bytes")) & F.col("_old").eqNullSafe(F.col("_new"))
    status = F.when(F.col("old_bytes").isNull(), "new").when(F.col("new_bytes").isNull(), "gone").when(same, "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), "old_bytes", "new_bytes")
