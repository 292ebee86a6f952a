import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import packing


def blocks_of(spark, lengths, length, parts=1):
    rows, at = [], 0
    for i, n in enumerate(lengths):
        rows.append((i, list(range(at, at + n)), n))
        at += n
    df = spark.createDataFrame(rows, "doc_id long, input_ids array<long>, num_tokens long").repartition(parts)
    return df, [r.input_ids for r in packing.pack(df, length, "doc_id").orderBy("seq").collect()]


@pytest.mark.parametrize(
    "lengths,length,sizes",
    [([4, 4], 4, [4, 4]), ([10], 4, [4, 4, 2]), ([3, 3, 3], 4, [4, 4, 1]), ([3, 0, 2], 4, [4, 1]), ([], 4, []), ([2, 1], 1, [1, 1, 1])],
)
def test_edges(spark, lengths, length, sizes):
    df, got = blocks_of(spark, lengths, length)
    assert [len(b) for b in got] == sizes
    assert sum(got, []) == list(range(sum(lengths)))
    s = packing.packing_stats(df, length).first()
    assert (s.total_sequences, s.num_examples) == (len(sizes), len(lengths))
    if not sizes:
        assert (s.avg_tokens_per_sequence, s.avg_examples_per_sequence) == (0, 0)


def test_any_partitioning(spark):
    lengths = [random.Random(7).randrange(0, 40) for _ in range(200)]
    want = blocks_of(spark, lengths, 16)[1]
    assert blocks_of(spark, lengths, 16, parts=7)[1] == want
    assert all(len(b) == 16 for b in want[:-1])


def test_length_must_be_positive(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.range(1), 0, "id")


def test_one_partition_holds_totals_alone(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(3).alias("num_tokens"), F.array_repeat(F.lit(1).cast("long"), 3).alias("input_ids"))
    plan = packing.pack(df, 8, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") <= 1
