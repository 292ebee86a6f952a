"""Tables that cut lineage: written to the folder that all executors share, then read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Only where the session names none, as in local tests, a temporary folder is set; there driver and executors are
    one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            found = set_dir.get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            found = tempfile.mkdtemp(prefix="corpusloom-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("spark.checkpoint.dir is not set: driver and executors share no folder")
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; dropped by drop_path() or by the cluster's retention."""
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends at files that survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df stored as a table of buckets by key, sorted in each, in the shared folder; joins on key find it dealt already.

    df should come dealt by repartition(buckets, key), done while its rows are still narrow: then a bucket is one file. Otherwise each
    task writes a file into every bucket that it has rows of.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path by Hadoop's file system, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables(*frames: DataFrame) -> None:
    """Removes the folders that frames made by materialize() read."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/corpusloom/" in path:
                drop_path(df.sparkSession, path)
