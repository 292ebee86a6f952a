import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup
from tests.llm import brute

KIND = "doc_id long, text string"


def got_of(spark, rows, **options):
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    return {r.doc_id: ([tuple(s) for s in r.removed_spans], r.clean_text) for r in line_dedup.dedup_lines(docs, **options).collect()}


def sentence(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n)).capitalize() + rng.choice(".!?")


def corpus(seed):
    """Texts with shared passages that begin and end inside lines, stutter, short lines that repeat by chance, ties."""
    rng = random.Random(seed)
    passages = [" ".join(sentence(rng, rng.randrange(3, 14)) for _ in range(8)) for _ in range(3)]
    short = ["All rights reserved.", "Yes.", "No.", "Read more"]
    rows = []
    for i in rng.sample(range(-20, 100), 40):
        parts = [sentence(rng, rng.randrange(2, 12)) for _ in range(rng.randrange(0, 8))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(short))
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), "cut in " + rng.choice(passages) + " then on")
        if rng.random() < 0.2:
            parts.insert(0, "ha!! " * 40)
        text = "".join(p + rng.choice([" ", "  ", "\n", "\r\n\t", " \n\n"]) for p in parts)
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return rows + [(101, rows[3][1]), (102, ""), (103, None), (104, " \n \n"), (105, passages[0]), (106, passages[0] + "\n" + passages[0])]


@pytest.mark.parametrize("seed,least_hot", [(1, 500), (2, 500), (3, 5)])
def test_passages_match_brute_force(spark, monkeypatch, seed, least_hot):
    monkeypatch.setattr(line_dedup.repeated_entries, "__defaults__", (*line_dedup.repeated_entries.__defaults__[:-1], least_hot))
    rows = corpus(seed)
    got = got_of(spark, rows)
    assert got == brute.passages(rows)
    assert any(s for s, _ in got.values()) and not got[min(i for i, _ in rows)][0]


def test_a_passage_goes_and_chance_lines_stay(spark):
    p = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. Fifteen sixteen seventeen eighteen nineteen twenty. Twenty one and two and three and four and five and six and seven."
    rows = [(1, f"Before it {p}\nAll rights reserved.\n"), (2, f"Another start, {p} After.\nAll rights reserved.\n"), (3, "All rights reserved.\nSomething else.\n")]
    got = got_of(spark, rows)
    assert got[1] == ([], rows[0][1]) and got[3] == ([], rows[2][1])
    (span,) = got[2][0]
    assert rows[1][1][span[0] :].startswith("Eight nine") and span[1] - span[0] >= 100
    assert got[2][1] == rows[1][1][: span[0]] + rows[1][1][span[1] :]


def test_the_earliest_place_of_a_passage_stays_whole(spark):
    """Each sentence of document 5 stands alone in an earlier one: no pair does."""
    parts = [f"Sentence {i} has quite a few words." for i in range(6)]
    rows = [(i, f"x{i}. {s} y{i}.") for i, s in enumerate(parts)] + [(10, " ".join(parts)), (11, " ".join(parts))]
    got = got_of(spark, rows)
    assert got[10][0] == [] and got[11][0] and got[11][1] == ""


def test_scripts_without_blanks_and_long_texts(spark):
    zh = "".join(chr(0x4E00 + (i * 37) % 5000) for i in range(220))
    long = " ".join(f"w{i} w{i + 1} w{i + 2}." for i in range(40_000))
    got = got_of(spark, [(1, zh), (2, f"a\n{zh}\nb"), (3, long), (4, f"new. {long} end.")])
    assert got[1][0] == [] == got[3][0]
    assert got[2] == ([(2, 223)], "a\nb")
    assert got[4] == ([(5, 6 + len(long))], "new. end.")


def test_rows_of_one_id(spark):
    """Two texts under one id are judged apart, and are no earlier than each other."""
    p = " ".join(f"Word{i} is in here." for i in range(10))
    rows = [(1, p), (2, f"{p}\nmine"), (2, "other text"), (2, "other text"), (2, f"{p}\nmine"), (3, f"x y z.\n{p}"), (3, f"{p}")]
    docs = spark.createDataFrame(rows, KIND)
    got = sorted((r.doc_id, r.clean_text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(1, p), (2, "mine"), (2, "mine"), (2, "other text"), (2, "other text"), (3, ""), (3, "x y z.\n")]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "mine", 5)], "doc_id long, text string, clean_text string, places int").withColumn("removed_spans", F.lit("s"))
    r = line_dedup.dedup_lines(docs).first()
    assert (r.clean_text_, r.removed_spans_, r.places, r.clean_text, r.removed_spans) == ("mine", "s", 5, "a", [])
    again = line_dedup.dedup_lines(line_dedup.dedup_lines(docs), text="clean_text").first()
    assert (again.clean_text, again.clean_text__) == ("a", "a")
