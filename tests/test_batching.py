import pytest
from pyspark.sql import functions as F

from corpusloom.operators import batching
from corpusloom.operators.runlog import Counters


@pytest.fixture()
def packed(spark):
    return spark.range(24).selectExpr("id AS seq", "array_repeat(CAST(id AS BIGINT), 8) AS input_ids").repartition(5)


def firsts(df):
    return [[r.input_ids[0] for r in rows] for _, rows in grouped(df)]


def grouped(df):
    out = {}
    for r in df.orderBy("batch_id", "pos").collect():
        out.setdefault(r.batch_id, []).append(r)
    return sorted(out.items())


def test_order_is_stable(packed):
    a = batching.assign_batches(packed, 4, ["seq"])
    assert firsts(a)[0] == [0, 1, 2, 3] and len(firsts(a)) == 6
    assert firsts(a) == firsts(batching.assign_batches(packed.repartition(3), 4, ["seq"]))


@pytest.mark.parametrize("skip", [0, 1, 2, 3])
def test_resume(packed, skip):
    a = batching.assign_batches(packed, 4, ["seq"])
    whole, rest = firsts(a), firsts(batching.skip_batches(a, skip))
    assert rest == whole[skip:]
    assert sorted(sum(whole[:skip] + rest, [])) == list(range(24))


def test_shards_part_the_batches(packed):
    a = batching.assign_batches(packed, 4, ["seq"])
    got = [firsts(batching.shard_batches(a, r, 4)) for r in range(4)]
    assert sorted(sum(sum(got, []), [])) == list(range(24))


def test_last_batch_is_short(spark):
    a = batching.assign_batches(spark.range(10).withColumnRenamed("id", "seq"), 4, ["seq"])
    assert [r["count"] for r in a.groupBy("batch_id").count().orderBy("batch_id").collect()] == [4, 4, 2]


def test_collate(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 9, 9]), (0, [4]), (0, [0, 5])], "batch_id long, input_ids array<long>")
    got = sorted(batching.collate(df, 3).collect(), key=lambda r: -sum(r.attention_mask))
    assert [r.input_ids for r in got] == [[1, 2, 3], [0, 5, 0], [4, 0, 0]]
    assert [r.attention_mask for r in got] == [[1, 1, 1], [1, 1, 0], [1, 0, 0]]
    assert got[2].labels == [4, -100, -100]
    assert batching.collate(df, 7, pad_to_max=True).where(F.size("input_ids") != 7).count() == 0


def test_counters(spark, tmp_path):
    c = Counters(3, 123, 45, 6789)
    d = Counters()
    d.load_state_dict(c.state_dict())
    assert c == d
    c.save(spark, f"{tmp_path}/state")
    assert Counters.restore(spark, f"{tmp_path}/state") == c
    c.roll_epoch(stopped=False)
    assert (c.epoch, c.step_in_epoch) == (4, 0)
