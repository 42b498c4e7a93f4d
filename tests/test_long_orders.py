"""Queries on tables whose orders have more lines than the given ones."""

import os

import duckdb
import pytest

import checks.all  # noqa: F401  (registers the queries)
from checks.compare import compare, connect
from checks.views import BASE_TABLES
from tests.conftest import SF


@pytest.fixture(scope="module")
def long_orders(tmp_path_factory):
    """sf0.001 with the lines of six orders in each order."""
    folder = tmp_path_factory.mktemp("long")
    for name in BASE_TABLES:
        if name != "lineitem":
            os.symlink(f"{SF}/{name}.parquet", folder / f"{name}.parquet")
    duckdb.execute(
        f"COPY (SELECT * REPLACE (l_orderkey // 6 AS l_orderkey) FROM '{SF}/lineitem.parquet')"
        f" TO '{folder}/lineitem.parquet' (FORMAT parquet)"
    )
    return str(folder)


@pytest.mark.parametrize("key", ["pad_or_cut", "shift_right"])
def test_long_sequences_are_padded_only_as_in_the_sql(spark, long_orders, key):
    same, note = compare(spark, connect(long_orders), long_orders, key)
    assert same, note
