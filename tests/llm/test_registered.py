"""Which queries are registered, and which of them SQL can express."""

import __spark_entry__ as contract
from scorelake.llm import queries

#: Tokenizers, fitted models, fingerprints linked by bits, byte suffixes and CRC-32 have no SQL: tests here check them.
WITHOUT_SQL = {
    "op2_simhash", "op3_language", "op5_main_text", "op7_suffix_dedup", "op9_token_files", "op10_packing",
    "op12_spelling", "op13_toxicity", "pipeline",
}


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(contract.queries()) - set(contract.oracle_sql()) == WITHOUT_SQL
