"""Every query of the domain against its oracle."""

import os

import oracle
import pytest

from kerbside.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert oracle.differences(spark, name, QUERIES[name], SQL[name], os.environ.get("ORACLE_SF", "sf0.001")) == ""
