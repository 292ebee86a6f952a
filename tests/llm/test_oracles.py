import pytest

from corpusloom.llm.catalog import LLM_ORACLES, LLM_QUERIES
from tests.oracle import connect, oracle_rows, rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(n for n, sql in LLM_ORACLES.items() if sql))
def test_matches_oracle(spark, name):
    assert rows_of(LLM_QUERIES[name](spark, SF)) == oracle_rows(connect(SF), LLM_ORACLES[name])
