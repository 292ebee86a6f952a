"""Stored tables: batches without shuffled arrays, other world sizes, splits written anew, pruned reads."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import batching
from corpusloom.sources import read_packed, read_split, replace_splits, write_one_file, write_packed, write_splits
from corpusloom.storage import bucketed


def above(plan, mark):
    """The operators above each line of a plan that holds mark."""
    stack, found = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|"))
        stack = [x for x in stack if x[0] < depth] + [(depth, line)]
        if mark in line:
            found.append([x for _, x in stack])
    return found


def test_arrays_are_not_shuffled(spark):
    tokens = spark.range(300).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(1), F.col("id") % 11 + 1), lambda x: x + F.col("id")).alias("input_ids"))
    counted = tokens.withColumn("num_tokens", F.size("input_ids").cast("long"))
    stored = bucketed(counted.repartition(4, "k"), "t", "k", 4)
    got = batching.collate_stored(stored, 7, 5, "k")
    want = batching.collate(batching.assign_batches(counted, 7, ["k"]), 5)
    columns = ["k", "batch_id", "pos", "input_ids", "attention_mask", "labels"]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(got) == rows(want)
    assert rows(batching.collate_stored(stored, 7, 5, "k", pad_to_max=True)) == rows(batching.collate(batching.assign_batches(counted, 7, ["k"]), 5, pad_to_max=True))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = batching.collate_stored(stored, 7, 5, "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = plan.split("== Initial Plan ==")[-1]
    scans = [x for x in above(plan, "FileScan") if "input_ids" in x[-1].split("Batched")[0]]
    assert len(scans) == 1 and not any("Exchange" in line for line in scans[0])


@pytest.mark.parametrize("sessions,world,n", [([], 3, 10), ([[2, 2]], 3, 24), ([[2, 1, 2, 2], [1, 0, 1]], 5, 40), ([[0, 0]], 1, 7), ([[9, 9, 9]], 2, 10), ([[1], [0, 3], [2, 2, 2, 1]], 2, 30)])
def test_other_world_sizes(spark, sessions, world, n):
    """Each batch is taken once; what is left keeps its order."""
    left, want = list(range(n)), {}
    for k, taken in enumerate([*sessions, None]):
        ranks = world if taken is None else len(taken)
        rest = []
        for i, b in enumerate(left):
            if taken is None or i // ranks < taken[i % ranks]:
                want[b] = (k, i % ranks, i // ranks)
            else:
                rest.append(b)
        left = rest
    df = spark.range(n).select(F.col("id").alias("batch_id"), F.lit("x").alias("_index"))
    got = batching.resume_sharded(df, sessions, world)
    assert got.columns == ["batch_id", "_index", "session", "rank", "turn"]
    assert {r.batch_id: (r.session, r["rank"], r.turn) for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_worlds_are_checked(spark):
    for sessions, world in (([], 0), ([[]], 2), ([[-1]], 2)):
        with pytest.raises(ValueError):
            batching.resume_sharded(spark.range(1).withColumnRenamed("id", "batch_id"), sessions, world)


def test_one_split_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "splits")
    df = spark.range(20).select("id", F.when(F.col("id") < 5, "test").otherwise("train").alias("split"), F.lit(1).alias("num_tokens"))
    write_splits(df, path)
    before = {f.name for f in (tmp_path / "splits/split=train").iterdir()}
    replace_splits(spark.range(3).select((F.col("id") + 100).alias("id"), F.lit("test").alias("split"), F.lit(1).alias("num_tokens")), path)
    assert {f.name for f in (tmp_path / "splits/split=train").iterdir()} == before
    assert sorted(r.id for r in read_split(spark, path, "test").collect()) == [100, 101, 102]
    assert read_split(spark, path, "train").count() == 15
    plan = read_split(spark, path, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_blocks_come_in_order_from_their_folders(spark, tmp_path):
    path = str(tmp_path / "packed")
    write_packed(spark.range(100).select(F.col("id").alias("seq"), F.array(F.col("id")).alias("input_ids")).repartition(6), path, rows=10)
    got = read_packed(spark, path, 25, 60, rows=10)
    assert [r.seq for r in got.collect()] == list(range(25, 60)) and got.first().input_ids == [25]
    scan = next(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(part" in scan and "part" in scan
    assert read_packed(spark, path).count() == 100
    files = spark.read.parquet(f"{path}/part=3").select("seq").collect()
    assert [r.seq for r in files] == list(range(30, 40))
    assert read_packed(spark, path, 0, 0, rows=10).count() == 0


def test_many_files_become_few(spark, tmp_path):
    paths = []
    for i in range(6):
        spark.range(i * 100, i * 100 + 100).write.parquet(f"{tmp_path}/in/{i}")
        paths.append(f"{tmp_path}/in/{i}")
    write_one_file(spark, paths, f"{tmp_path}/one")
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    size = sum(f.stat().st_size for f in (tmp_path / "in").rglob("*.parquet"))
    write_one_file(spark, paths, f"{tmp_path}/three", target=size // 2)
    assert 2 <= len(list((tmp_path / "three").glob("part-*"))) <= 3
    assert spark.read.parquet(f"{tmp_path}/three").count() == spark.read.parquet(f"{tmp_path}/one").count() == 600


def test_a_merged_file_is_one_scan_task_s(spark, tmp_path):
    """A large source's files hold some 128 MB each, by default too: no task reads most of it."""
    path = str(tmp_path / "in")
    spark.range(0, 45_000_000, 1, 8).select(F.rand(1).alias("x")).write.parquet(path)
    write_one_file(spark, [path], f"{tmp_path}/merged")
    sizes = [f.stat().st_size for f in (tmp_path / "merged").glob("part-*")]
    assert sum(sizes) > 300_000_000 and 3 <= len(sizes) <= 4 and max(sizes) < 200_000_000
    assert spark.read.parquet(f"{tmp_path}/merged").count() == 45_000_000
