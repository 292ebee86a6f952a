"""Exact deduplication by an extendible-hash index on shared files. Native: DataFrame functions alone.

1. A row's key is a 64-bit hash of its whole text. Keys are counted, and their numbers by prefix, 2**MAX_DEPTH at most,
   make the directory on the driver: it doubles until no bucket holds more keys than its capacity.
2. Each row probes the directory with its key's prefix and goes to the bucket that stands there. A task owns whole
   buckets, hence ranges of keys. It sorts its rows by key and text: rows of one key are a chain, in which different texts
   that collide stay apart, as their bytes are compared.
3. Owners write what they found, one folder per bucket, to the shared folder; the result is read from there.

Rows of a hot key, at most HOT of them, don't meet in their owner: each task combines them by key and text, bytes
compared, before the shuffle; the combined entries, a row per text, are sent back to the rows by key and digest.

Defined results: null text counts as empty; an empty table gives no rows; of equal texts the largest doc_id stays, and
rows that repeat both doc_id and text are kept or dropped together; a null doc_id is smaller than any other, and rows
whose text has no other are kept with a null keep_id; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_IDS
from corpusloom.schemas import require
from corpusloom.storage import drop_tables, materialize, scratch_path

#: Keys of a bucket before it splits, and the directory's largest depth: it has 2**MAX_DEPTH places at most.
CAPACITY, MAX_DEPTH = 2048, 16
#: A key with more rows than this, and than 1/HOT of all, is combined in each task before it is dealt: HOT keys at most.
LEAST_HOT, HOT = 1000, 10_000


def directory(counts: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Global depth and the bucket of every directory place; counts: entries by prefix of max_depth bits.

    Starts with one bucket and doubles the directory until no bucket is overfull. Buckets that are not overfull keep
    their lower depth and stand at several places.
    """
    level = [counts.get(i, 0) for i in range(1 << max_depth)]
    sums = [level]
    while len(level) > 1:
        level = [level[i] + level[i + 1] for i in range(0, len(level), 2)]
        sums.append(level)
    sums.reverse()  # sums[d][p]: entries whose prefix of d bits is p
    leaves, depth, todo = [], 0, [(0, 0)]
    while todo:
        d, p = todo.pop()
        if sums[d][p] > capacity and d < max_depth:
            todo += [(d + 1, 2 * p + 1), (d + 1, 2 * p)]
            depth = max(depth, d + 1)
        else:
            leaves.append((d, p))
    places = [0] * (1 << depth)
    for bucket, (d, p) in enumerate(leaves):
        for i in range(p << (depth - d), (p + 1) << (depth - d)):
            places[i] = bucket
    return depth, places


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _placed(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(place, bucket) of the directory for a table of distinct keys, and its depth."""
    counts = {r[0]: r[1] for r in keys.groupBy(_prefix(F.col("h"), MAX_DEPTH).alias("p")).count().collect()}
    depth, places = directory(counts, max(capacity, sum(counts.values()) >> (MAX_DEPTH - 2)))
    return keys.sparkSession.createDataFrame(list(enumerate(places)), "place int, bucket int"), depth


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The written index, a row per row of docs: (bucket, h, id, text_sha256, keep_id, group_size)."""
    require(docs, key, text)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", _key(F.col("t")))
    keys = materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "dedup-keys")
    places, depth = _placed(keys, capacity)
    probed = rows.join(F.broadcast(places), _prefix(F.col("h"), depth) == F.col("place")).drop("place")  # 2**MAX_DEPTH places at most
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = materialize(keys.where(F.col("n") > max(LEAST_HOT, total // HOT)).select("h"), "dedup-hot")  # fewer than HOT keys, as n sums to total
    sha = F.sha2("t", 256).alias("text_sha256")

    chain = Window.partitionBy("bucket", "h", "t")
    owned = probed.join(F.broadcast(hot), "h", "left_anti").repartition("bucket").sortWithinPartitions("bucket", "h", "t")
    found = owned.select("bucket", "h", "id", sha, F.max("id").over(chain).alias("keep_id"), F.count(F.lit(1)).over(chain).alias("group_size"))
    path = scratch_path(spark, "dedup-index")
    found.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/owned")
    parts = [spark.read.schema(found.schema).parquet(f"{path}/owned")]

    if hot.head(1):
        some = probed.join(F.broadcast(hot), "h", "left_semi")
        texts = some.groupBy("bucket", "h", "t").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        entries = materialize(texts.select("h", sha, "keep_id", "group_size"), "dedup-hot-entries")
        few = entries.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        back = some.select("bucket", "h", "id", sha).join(F.broadcast(entries) if few else entries, ["h", "text_sha256"])
        back.select(*found.columns).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/hot")
        parts.append(spark.read.schema(found.schema).parquet(f"{path}/hot"))
        drop_tables(entries)
    drop_tables(keys, hot)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256."""
    found = build_index(docs, key, text, capacity)
    return found.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
