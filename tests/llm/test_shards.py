import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sharding

KIND = "doc_id long, text string, path string, run int"


def rows(spark, i, n=20, size=1):
    return spark.createDataFrame([(i * 1000 + j, f"batch {i} row {j} " * size, "p", 1) for j in range(n)], KIND).coalesce(1)


def test_versions_conflicts_and_vacuum(spark, tmp_path):
    root = f"{tmp_path}/shards"
    for i in range(4):
        sharding.append(rows(spark, i), root)
    first = sharding.latest(spark, root)
    assert first["version"] == 4 and sharding.read(spark, root).count() == 80
    after = sharding.compact(spark, root)
    assert sharding.live_files(spark, after).count() == 1 and sharding.live_files(spark, first).count() == 4
    assert sharding.read(spark, root).count() == sharding.read(spark, root, first).count() == 80
    with pytest.raises(sharding.Conflict):
        sharding.commit(spark, root, sharding.live_files(spark, first), first["schema"], first)
    assert sharding.compact(spark, root)["version"] == 5
    sharding.append(spark.createDataFrame([], KIND), root)
    sharding.append(rows(spark, 9), root)
    assert sharding.read(spark, root).count() == 100
    assert sharding.vacuum(spark, root, keep=3) and sharding.read(spark, root).count() == 100
    assert sharding.read(spark, root, after).count() == 80  # one of the last three
    assert sorted(r.doc_id for r in sharding.read(spark, root).collect()) == sorted(i * 1000 + j for i in (0, 1, 2, 3, 9) for j in range(20))


def test_a_second_writer_tries_again(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/race"
    sharding.append(rows(spark, 0), root)
    plain, raced = sharding.commit, []

    def commit(*a):
        if not raced:
            raced.append(1)
            sharding.append(rows(spark, 1), root)  # comes first
        return plain(*a)

    monkeypatch.setattr(sharding, "commit", commit)
    sharding.append(rows(spark, 2), root)
    assert sharding.latest(spark, root)["version"] == 3 and sharding.read(spark, root).count() == 60


@pytest.mark.parametrize("merge", [False, True])
def test_vacuum_beside_a_writer(spark, tmp_path, monkeypatch, merge):
    """vacuum() runs when an append's or a merge's files are written and not yet committed: they stay."""
    root = f"{tmp_path}/beside"
    for i in range(4):
        sharding.append(rows(spark, i), root)
    plain, cleaned = sharding._commit_on_newest, []

    def late(*a):
        cleaned.append(sharding.vacuum(spark, root, keep=1))
        return plain(*a)

    monkeypatch.setattr(sharding, "_commit_on_newest", late)
    sharding.compact(spark, root) if merge else sharding.append(rows(spark, 7), root)
    assert cleaned == [[]] and sharding.read(spark, root).count() == (80 if merge else 100)
    sharding.vacuum(spark, root, keep=1)
    assert sharding.read(spark, root).count() == (80 if merge else 100)
    assert len(list((tmp_path / "beside/data").iterdir())) == (1 if merge else 5)
    assert len([x for x in (tmp_path / "beside/manifest").iterdir() if x.is_dir()]) == 1
    assert sharding.latest(spark, root)["version"] == 5
    sharding.append(rows(spark, 8), root)  # numbers go on
    assert sharding.latest(spark, root)["version"] == 6


def test_a_writer_whose_files_are_gone_commits_nothing(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/gone"
    sharding.append(rows(spark, 0), root)
    plain = sharding._commit_on_newest

    def late(*a):
        assert len(sharding.vacuum(spark, root, orphan_seconds=-1)) == 1
        return plain(*a)

    monkeypatch.setattr(sharding, "_commit_on_newest", late)
    with pytest.raises(sharding.Vanished):
        sharding.append(rows(spark, 1), root)
    assert sharding.latest(spark, root)["version"] == 1 and sharding.read(spark, root).count() == 20


def test_only_similar_sizes_merge(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TARGET_BYTES", 1 << 20)
    sizes = [1000] * 3 + [60_000] * 5 + [900_000, 800_000, 1 << 20, 2 << 20] + [300_000] * 6
    files = spark.createDataFrame([(f"f{i}", n, 1, 0) for i, n in enumerate(sizes)], sharding.FILES)
    files = files.withColumn("tier", sharding._tier(F.col("bytes")))
    merged = {}
    for r in sharding.plan(files).collect():
        merged.setdefault((r.tier, r.run), []).append(r.bytes)
    assert all(max(x) < sharding.FAN_IN * min(x) and len(x) > 1 for x in merged.values())
    flat = sorted(b for x in merged.values() for b in x)
    assert flat.count(60_000) == 5 and 1000 not in flat and max(flat) < 1 << 20 and flat.count(300_000) >= 4


def test_bytes_are_rewritten_a_few_times_only(spark, monkeypatch):
    """Many small arrivals, merged as they come: by the plan alone, a merged file has its parts' bytes."""
    monkeypatch.setattr(sharding, "TARGET_BYTES", 64_000)
    live, rewritten = [], 0
    for i in range(40):
        live.append((f"a{i}", 1000))
        if i % 4 < 3:
            continue
        files = spark.createDataFrame([(p, n, 1, 0) for p, n in live], sharding.FILES).withColumn("tier", sharding._tier(F.col("bytes")))
        runs = {}
        for r in sharding.plan(files).collect():
            runs.setdefault((r.tier, r.run), []).append((r.path, r.bytes))
        for k, x in runs.items():
            rewritten += sum(n for _, n in x)
            live = [f for f in live if f not in x] + [(f"m{i}-{k}", sum(n for _, n in x))]
    assert sum(n for _, n in live) == 40_000
    assert rewritten <= 2.5 * 40_000 and len(live) <= 8


def test_each_run_has_a_task_of_its_own(spark):
    for n in (1, 7, 60):
        keys = sharding._own_tasks(spark, n)
        assert keys.repartition(n, "key").select(F.spark_partition_id()).distinct().count() == n == keys.select("key").distinct().count()
