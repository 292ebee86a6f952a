import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, near_dedup
from tests.llm import brute

KIND = "doc_id long, text string"


def variants(rng, base, n, most):
    words = [f"w{i}" for i in range(300)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(most + 1)):
            t[rng.randrange(len(t))] = rng.choice(words)
        yield " ".join(t)


@pytest.mark.parametrize("least,block", [(500, 4096), (3, 4)])
def test_hot_buckets_leaders_and_blocks(spark, monkeypatch, least, block):
    """A family of near copies, and one of texts that are alike but under the threshold; broadcast and shuffled branches."""
    monkeypatch.setattr(common.skew_join, "__defaults__", (common.HOT_KEYS, least))
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    a, b = ([f"{c}{i}" for i in range(120)] for c in "ab")
    texts = [*variants(rng, a, 30, 6), *variants(rng, b, 25, 30), *variants(rng, a[:60] + b[:60], 10, 4), "x y", "x y", None]
    docs = spark.createDataFrame(list(enumerate(texts)), KIND).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, 4).collect()}
    assert got == brute.near(list(enumerate(texts)), 4, 80)


def test_texts_that_share_an_id(spark):
    """Each text is linked for itself, whatever the order of rows."""
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    rows = [(5, one), (5, two), (3, one + " end"), (9, two + " end"), (5, two), (None, one + " stop"), (None, "lonely text of five words")]
    want = sorted([(5, 3, False), (5, 5, True), (5, 5, True), (3, 3, True), (9, 5, False), (None, 3, False), (None, None, True)], key=str)
    got = near_dedup.near_groups(spark.createDataFrame(rows, KIND).repartition(4), 4).collect()
    assert sorted([(r.doc_id, r.component_id, r.kept) for r in got], key=str) == want


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 900)]
    links = spark.createDataFrame(chain[::-1] + star, "a long, b long")
    got = {r.id: r.component for r in near_dedup.components(links).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 900))}


def test_skew_join_gives_the_plain_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 39")
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    for least in (10, 500, 5000):
        assert sorted(map(tuple, common.skew_join(rows, table, "k", "n", least=least).select("k", "id", "n").collect())) == want
