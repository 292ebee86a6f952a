"""Plain texts are encoded from the ranks alone, where these tell the definition's ids."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.operators.byte_level import Encoder, ranks_suffice
from corpusloom.operators.tokenizers import BpeTokenizer


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def texts(rng):
    parts = ["the", "ing", " ", "  ", "\n", "'ll", "'S", "12", "é", "ß", "_--", "<|eos|>", "<|endoftext|>", "λόγος", "日本", "\x1c", "\x85", "🙂"]
    yield from ("", " ", "a" * 5000, " " * 5000 + "x", "thein" * 1000 + " end")
    for n in (12, len(parts)):
        yield from ("".join(rng.choice(parts[:n]) for _ in range(rng.randrange(60))) for _ in range(200))


def test_plain_texts_need_no_merges(definition):
    encoder = Encoder(definition)
    for t in ("The cat's 12 été--", "x<|eos|>", ""):
        assert encoder.plain(t) and encoder.array(t).tolist() == encoder.encode(t)
    assert encoder._exact is None
    assert not any(map(encoder.plain, ("<|endoftext|>", "日本", "a" * 5000, " " * 5000)))


def test_rows_have_the_definition_s_ids(spark, definition):
    exact, rows = Tokenizer.from_str(definition), list(enumerate(texts(random.Random(1))))
    assert ranks_suffice(definition)
    got = BpeTokenizer(definition).tokenize(spark.createDataFrame(rows, "k int, text string")).collect()
    for r in got:
        assert r.input_ids == exact.encode(rows[r.k][1], add_special_tokens=False).ids and r.num_tokens == len(r.input_ids)
    assert len(got) == len(rows)


def test_ranks_that_do_not_suffice(spark, definition):
    """A token that no merge makes, or settings that the ranks don't hold: tokenizers' own ids."""
    d = json.loads(definition)
    d["model"]["vocab"]["qqxzq"] = d["added_tokens"][0]["id"] = len(d["model"]["vocab"]) + 10
    d["added_tokens"] = []
    odd = json.dumps(d)
    assert not ranks_suffice(odd) and not ranks_suffice(json.dumps(json.loads(definition) | {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}}))
    want = Tokenizer.from_str(odd).encode("qqxzq the", add_special_tokens=False).ids
    assert [r.input_ids for r in BpeTokenizer(odd).tokenize(spark.createDataFrame([("qqxzq the",)], "text string")).collect()] == [want]
