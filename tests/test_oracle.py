"""Every query of the catalogue against its SQL twin on DuckDB."""

import pytest

from checks.compare import connect, differences
from checks.oracle_sql import oracle_sql
from checks.catalog import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert sorted(queries()) == sorted(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_oracle(spark, duck, name):
    assert differences(queries()[name](spark, SF_DIR), duck, oracle_sql()[name]) == []
