"""Benchmark blocks and column names that clash in another case of letters."""

import pickle
import random
import tracemalloc

from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, suffix_decontam

ITEMS = "item_id int, text string"


def test_a_block_s_memory_follows_its_text():
    """A full block of short words: what a worker holds of it, and what making it takes."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30_000)]
    items, size = [], 0
    while size < suffix_decontam.BLOCK_BYTES:
        text = " ".join(rng.choice(words) for _ in range(400))
        items.append((str(len(items)), suffix_decontam.words_of(text)))
        size += len(text) + 64
    tracemalloc.start()
    q = suffix_decontam.Queries(items)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(q.low) > 150_000
    assert len(pickle.dumps(q)) < 40 << 20 and most < 150 << 20


def test_columns_in_any_case_of_letters(spark):
    said = "a b c d e f g h i j k"
    kind = "doc_id int, text string, _ROW int, Clean_Text string, REMOVED_SPANS int, places int"
    docs = spark.createDataFrame([(1, said, 7, "mine", 3, 4), (2, "other words here", 8, "mine", 3, 4), (3, said.upper(), 9, "mine", 3, 4)], kind)
    items = spark.createDataFrame([(i, said if i == 5 else f"x{i} y{i} z{i}") for i in range(40)], ITEMS)
    assert len(list(suffix_decontam.query_blocks(items, block_bytes=300))) > 2
    left = suffix_decontam.decontaminate(docs, items, block_bytes=300)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "other words here", 8, "mine", 3, 4)]
    got = line_dedup.dedup_lines(docs)
    lower = [c.lower() for c in got.columns]
    assert len(set(lower)) == len(lower) and got.count() == 3
    assert {r["clean_text"] for r in got.select("clean_text").collect()} == {said, "other words here", said.upper()}
    assert got.where(F.col(got.columns[3]) == "mine").count() == 3


def test_blocks_are_looked_up_in_one_scan(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "q")], "doc_id int, text string")
    items = spark.createDataFrame([(i, f"w{i} a b c" if i % 2 else f"b{i}") for i in range(50)] + [(50, "a b c"), (51, "b")], ITEMS)
    got = suffix_decontam.contamination(docs, items, block_bytes=200)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.longest_match, r.match_start) for r in got.collect()}
    assert rows == {1: (3, 3, ["50", "51"], 3, 0), 2: (1, 0, [], 0, -1)}
