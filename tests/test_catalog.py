import pytest

from corpusloom.plans.oracles import ORACLES
from corpusloom.plans.queries import QUERIES
from tests.oracle import connect, oracle_rows, rows_of

SF = "/root/testdata/sf0.001"
NO_ORACLE = {"tokenize_bpe"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == NO_ORACLE


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == oracle_rows(connect(SF), ORACLES[name].replace("sf0.01", "sf0.001"))


def test_ids_are_the_definition_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = exact.encode(r.text + "<|eos|>", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sum(x * (i + 1) for i, x in enumerate(ids))))
    assert {tuple(r) for r in QUERIES["tokenize_bpe"](spark, SF).select("doc_id", "n_tokens", "checksum").collect()} == want
