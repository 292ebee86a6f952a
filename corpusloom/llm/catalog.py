"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from corpusloom.llm import queries_free as free
from corpusloom.llm import queries_native as native


def _number(name: str) -> int:
    return int(name[2:].split("_")[0])


LLM_QUERIES = dict(sorted((free.QUERIES | native.QUERIES).items(), key=lambda x: _number(x[0]))) | {"pipeline": corpus_pipeline.run}
LLM_ORACLES = free.ORACLES | native.ORACLES
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
