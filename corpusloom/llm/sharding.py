"""Sharding by size-tiered compaction with versioned manifests. Native: DataFrame functions alone.

append() writes an arrival as small immutable files, one per task, without a shuffle. compact() puts the live files in tiers
by size, each FAN_IN times larger than the one below; a tier with FAN_IN files and more is cut into runs of the target size,
and each run that is full or has FAN_IN files becomes one file. Files merge with files of their own tier alone, so a byte is
rewritten once per tier at most, and few small files wait for more of their kind.

A version is a table of live files plus a small pointer file; the pointer is written under another name and renamed to its
own without overwriting, so a version appears whole or not at all and two writers can't both commit it. A writer that comes
second tries again on the newer version: an append always can, a compaction if its files are still live. Readers read what
the newest pointer lists: files of lost or repeated tasks and of failed writers are never seen. vacuum() removes folders that
earlier versions used and none of the last ones does, and what failed writers left once it is old; a folder that no version
lists may be that of a writer about to commit. A writer looks whether its folder is there before it commits.

The list of files is itself a table: planning runs on it as DataFrames with bucketed running sums.

Defined results: null text counts as 0 bytes and stays null; an empty arrival adds no file; repeated rows are stored as
often as they come; further columns are stored too.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.prefix import prefix_sum
from corpusloom.storage import drop_path

#: Bytes of a merged file, and the ratio of sizes between tiers.
TARGET_BYTES, FAN_IN = 64 << 20, 4
#: Tiers below the target: sizes down to TARGET_BYTES / FAN_IN ** TIERS.
TIERS = 6
#: Files of a plan that is broadcast at most; a longer plan is joined by shuffle.
BROADCAST_FILES = 200_000
FILES = "path string, bytes long, n_rows long, tier int"
#: Times that a writer tries to commit on newer versions; versions whose files vacuum() keeps.
TRIES, KEEP_VERSIONS = 10, 2
#: Seconds that a folder which no version lists is left alone: longer than any append or merge takes from its first file to its commit.
ORPHAN_SECONDS = 7 * 86_400


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class Vanished(RuntimeError):
    """A writer's files are gone before it could commit them: nothing was committed."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).head()[0]


def latest(spark: SparkSession, root: str) -> dict | None:
    """The newest committed manifest pointer: {version, files, schema}; None before the first commit."""
    fs, p = _fs(spark, f"{root}/manifest")
    if not fs.exists(p):
        return None
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    done = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
    return json.loads(_read(spark, f"{root}/manifest/v{max(done)}.json")) if done else None


def commit(spark: SparkSession, root: str, files: DataFrame, schema: str, base: dict | None) -> dict:
    """Commits files as the version after base; raises if another writer has committed it meanwhile."""
    version = (base["version"] if base else 0) + 1
    table = f"{root}/manifest/files-{version}-{uuid.uuid4().hex[:8]}"
    files.write.parquet(table)
    pointer = {"version": version, "files": table, "schema": schema}
    fs, tmp = _fs(spark, f"{root}/manifest/.tmp-{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(json.dumps(pointer).encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/v{version}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(tmp, target, none)  # fails if the version is there
    except Exception as e:
        fs.delete(tmp, False)
        raise Conflict(f"version {version} was committed by another writer") from e
    return pointer


def _tier(size) -> Column:
    """0 for files of the target size and more; one more for each factor of FAN_IN below it."""
    below = F.floor(F.log(float(FAN_IN), F.lit(float(TARGET_BYTES)) / F.greatest(size, F.lit(1)).cast("double"))) + 1
    return F.when(size >= TARGET_BYTES, 0).otherwise(F.least(below, F.lit(TIERS))).cast("int")


def _describe(df: DataFrame) -> DataFrame:
    """A row per data file of df, by the files' own metadata."""
    per = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return per.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("n_rows")).select("path", "bytes", "n_rows", _tier(F.col("bytes")).alias("tier"))


def _unused(columns: list[str], name: str) -> str:
    """name, or name with a number, that no column has."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}{i}" for i in range(len(columns) + 1))) if n not in taken)


def live_files(spark: SparkSession, pointer: dict) -> DataFrame:
    return spark.read.schema(FILES).parquet(pointer["files"])


def _type(schema: str) -> StructType:
    return StructType.fromJson(json.loads(schema))


def _of(spark: SparkSession, root: str, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(_type(schema)).option("recursiveFileLookup", True).parquet(f"{root}/data/{folder}")


def _commit_on_newest(spark: SparkSession, root: str, schema: str, folder: str, files: Callable[[dict | None], DataFrame]) -> dict:
    """Commits what files makes of the newest version, with the files of folder; on a conflict again, of a newer one."""
    for _ in range(TRIES):
        base = latest(spark, root)
        listed = files(base)
        fs, written = _fs(spark, f"{root}/data/{folder}")
        if not fs.exists(written):
            raise Vanished(f"{written} was removed before it was committed")
        try:
            return commit(spark, root, listed, schema, base)
        except Conflict:
            continue
    raise Conflict(f"{root}: {TRIES} other writers came first")


def append(df: DataFrame, root: str) -> dict:
    """Adds df's rows as new small files (one per task that has rows) and commits them; returns the new pointer."""
    spark, schema, folder = df.sparkSession, df.schema.json(), f"a-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(f"{root}/data/{folder}")
    table = f"{root}/manifest/arrival-{folder}"
    _describe(_of(spark, root, folder, schema)).write.parquet(table)
    files = spark.read.schema(FILES).parquet(table)
    pointer = _commit_on_newest(spark, root, schema, folder, lambda base: live_files(spark, base).unionByName(files) if base else files)
    drop_path(spark, table)
    return pointer


def plan(files: DataFrame) -> DataFrame:
    """(path, bytes, tier, run) of the files that merge: those of one tier and run become one file.

    A tier's files, in the order of their paths' hashes, are cut where their sum reaches the target size. The last run of a
    tier waits unless it has FAN_IN files. Runs have two files at least.
    """
    small = files.where("tier > 0").withColumn("_h", F.xxhash64("path"))
    placed = prefix_sum(small, F.col("bytes"), ["tier", "_h", "path"], F.col("tier") * 4096 + 2048 + F.shiftright("_h", 52), "_at")
    tiers = small.groupBy("tier").agg(F.count(F.lit(1)).alias("_files"), F.sum("bytes").alias("_bytes"))
    first = placed.groupBy("tier").agg(F.min("_at").alias("_first")).join(tiers, "tier")
    runs = placed.join(F.broadcast(first), "tier").where(F.col("_files") >= FAN_IN).withColumn("run", F.floor((F.col("_at") - F.col("_first")) / TARGET_BYTES))  # a row per tier
    last = F.floor((F.col("_bytes") - 1) / TARGET_BYTES)
    sized = runs.groupBy("tier", "run").agg(F.count(F.lit(1)).alias("_n"))
    return runs.join(sized, ["tier", "run"]).where((F.col("_n") >= FAN_IN) | (F.col("_n") > 1) & (F.col("run") < last)).select("path", "bytes", "tier", "run")


def _own_tasks(spark: SparkSession, n: int) -> DataFrame:
    """(number, key) for the numbers from 0 to n-1: repartition(n, key) sends each key to a task of its own."""
    tried = spark.range(n * (20 + n.bit_length())).select(F.col("id").cast("int").alias("key"))
    found = tried.groupBy(F.pmod(F.hash("key"), F.lit(n)).cast("long").alias("number")).agg(F.min("key").alias("key"))
    return spark.range(n).withColumnRenamed("id", "number").join(found, "number", "left").select("number", F.coalesce("key", F.col("number").cast("int")).alias("key"))


def compact(spark: SparkSession, root: str) -> dict:
    """Merges runs of similarly sized files and commits the result; the files that it replaces stay for older readers."""
    base = latest(spark, root)
    if base is None:
        raise ValueError(f"nothing was appended to {root}")
    table, schema = f"{root}/manifest/plan-{uuid.uuid4().hex[:8]}", base["schema"]
    planned = plan(live_files(spark, base))
    planned.write.parquet(table)
    planned = spark.read.schema(planned.schema).parquet(table)
    runs = planned.select("tier", "run").distinct()
    n = runs.count()
    if not n:
        drop_path(spark, table)
        return base
    _numbered(runs).join(_own_tasks(spark, n), "number").select("tier", "run", "key").write.parquet(f"{table}-runs")
    keys = spark.read.schema("tier int, run long, key int").parquet(f"{table}-runs")
    merging = planned.join(F.broadcast(keys) if n <= BROADCAST_FILES else keys, ["tier", "run"]).select("path", "key")
    few = planned.count() <= BROADCAST_FILES
    rows, path = _live_rows(spark, root, base)
    run = _unused(rows.columns, "run")
    merging = merging.select(F.col("path").alias(path), F.col("key").alias(run))
    folder = f"c-{uuid.uuid4().hex[:8]}"
    rows = rows.join(F.broadcast(merging) if few else merging, path).drop(path)
    rows.repartition(n, run).write.option("compression", "zstd").partitionBy(run).parquet(f"{root}/data/{folder}")
    merged = f"{table}-merged"
    _describe(_of(spark, root, folder, schema)).write.parquet(merged)
    gone, made = planned.select("path"), spark.read.schema(FILES).parquet(merged)

    def files(newest: dict) -> DataFrame:
        live = live_files(spark, newest)
        if live.join(gone, "path", "left_semi").count() < gone.count():
            raise RuntimeError("another compaction has replaced the files")
        return live.join(gone, "path", "left_anti").unionByName(made)

    pointer = _commit_on_newest(spark, root, schema, folder, files)
    for p in (table, f"{table}-runs", merged):
        drop_path(spark, p)
    return pointer


def _numbered(runs: DataFrame) -> DataFrame:
    """runs (tier, run) with number from 0; a row per merged file."""
    h = runs.withColumn("_h", F.xxhash64("tier", "run"))
    return prefix_sum(h, F.lit(1), ["_h", "tier", "run"], F.shiftright("_h", 52), "number").select("tier", "run", "number")


def _folders(spark: SparkSession, pointer: dict) -> set[str]:
    """The data folders that a version lists: one per append or merge that is live in it."""
    return {r[0] for r in live_files(spark, pointer).select(F.regexp_extract("path", r"/data/([^/]+)/", 1)).distinct().collect()}


def vacuum(spark: SparkSession, root: str, keep: int = KEEP_VERSIONS, orphan_seconds: float = ORPHAN_SECONDS) -> list[str]:
    """Removes the data folders that earlier versions list and none of the last keep does; returns their names.

    Lists of files of the earlier versions go too, so that these can't be read any more; the pointers stay, as they hold the
    numbers that writers can't use again. A folder that no version lists goes only when it is older than orphan_seconds: a
    younger one may be about to be committed. Give readers time: keep as many versions as are committed while one of them reads.
    """
    newest = latest(spark, root)
    if newest is None:
        return []
    fs, manifest = _fs(spark, f"{root}/manifest")
    tables = {x.getPath().getName() for x in fs.listStatus(manifest) if x.isDirectory()}
    first = newest["version"] - max(keep, 1) + 1
    listed = [p for v in range(1, newest["version"] + 1) if (p := json.loads(_read(spark, f"{root}/manifest/v{v}.json")))["files"].rsplit("/", 1)[-1] in tables]
    used: set[str] = set().union(*(_folders(spark, p) for p in listed if p["version"] >= first))
    earlier: set[str] = set().union(*(_folders(spark, p) for p in listed if p["version"] < first))
    found = {x.getPath().getName(): x.getModificationTime() / 1000 for x in fs.listStatus(_fs(spark, f"{root}/data")[1])}
    old = {n for n, changed in found.items() if time.time() - changed > orphan_seconds}
    gone = sorted(n for n in found if n not in used and (n in earlier or n in old))
    for name in gone:
        drop_path(spark, f"{root}/data/{name}")
    for p in listed:
        if p["version"] < first:
            drop_path(spark, p["files"])
    return gone


def _live_rows(spark: SparkSession, root: str, pointer: dict) -> tuple[DataFrame, str]:
    """The rows of a version's live files, and the name of a column that has each row's file.

    The version's folders are read; files in them that it doesn't list are left out by a join on the path.
    """
    listed = live_files(spark, pointer).select("path")
    folders = [r[0] for r in listed.select(F.regexp_extract("path", r"/data/([^/]+)/", 1)).distinct().collect()]  # one per append or merge that is live
    schema = _type(pointer["schema"])
    name = _unused(schema.names, "path")
    if not folders:
        return spark.createDataFrame([], schema).withColumn(name, F.lit("")), name
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{root}/data/{f}" for f in folders]).withColumn(name, F.col("_metadata.file_path"))
    few = listed.count() <= BROADCAST_FILES
    listed = listed.withColumnRenamed("path", name)
    return rows.join(F.broadcast(listed) if few else listed, name, "left_semi"), name


def read(spark: SparkSession, root: str, pointer: dict | None = None) -> DataFrame:
    """The rows of a version, by default the newest."""
    rows, path = _live_rows(spark, root, pointer or latest(spark, root))
    return rows.drop(path)
