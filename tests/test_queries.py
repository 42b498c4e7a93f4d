"""Every registered query against its SQL in DuckDB."""

import pytest

import checks.all  # noqa: F401
from checks.compare import compare, connect
from checks.registry import CHECKS
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(CHECKS))
def test_query(spark, con, key):
    same, note = compare(spark, con, SF, key)
    assert same, note


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(CHECKS) <= set(contract.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as contract

    out = contract.entry(spark)
    assert out.columns[-2:] == ["meta", "note_seq"]
    assert out.count() > 0
