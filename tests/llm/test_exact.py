import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup

KIND = "doc_id long, text string"


def plain(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    most = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return sorted(((i, most[t or ""], len(by[t or ""]), i == most[t or ""]) for i, t in rows), key=str)


def told(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("capacity,hot,clash", [(2048, 1000, False), (3, 1000, False), (3, 4, False), (2, 1000, True), (2, 4, True)])
def test_results_come_through_split_buckets(spark, monkeypatch, capacity, hot, clash):
    """Small buckets split; keys of few values make chains of unlike texts; hot keys are combined first."""
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", hot)
    if clash:
        monkeypatch.setattr(exact_dedup, "_key", lambda t: F.shiftleft(F.length(t).cast("long"), 58))
    rng = random.Random(capacity)
    rows = [(i, rng.choice([None, "", "a", "b", "ab", "ba", "abc", "cba"] + [f"text {j}" for j in range(30)])) for i in rng.sample(range(1000), 150)]
    rows += [(None, "ab"), (None, "only here"), (rows[0][0], rows[0][1]), (rows[1][0], "other text, same id")]
    docs = spark.createDataFrame(rows, KIND).repartition(4)
    index = exact_dedup.build_index(docs, capacity=capacity)
    if capacity < 10:
        assert index.select("bucket").distinct().count() > 2
        assert index.groupBy("h").agg(F.count_distinct("bucket").alias("n")).where("n > 1").count() == 0
    assert told(exact_dedup.exact_groups(docs, capacity=capacity)) == plain(rows)


def test_very_long_texts(spark):
    a, b = "x" * 3_000_000, "x" * 2_999_999 + "y"
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], KIND)
    assert told(exact_dedup.exact_groups(docs)) == plain([(1, a), (2, b), (3, a)])
