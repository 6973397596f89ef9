"""Queries that SQL can express against their oracles, and the others' shape."""

import os

import oracle
import pytest

pytest.importorskip("kerbside.llm")

from kerbside.llm.oracles import SQL  # noqa: E402
from kerbside.llm.queries import QUERIES  # noqa: E402

SF = os.environ.get("ORACLE_SF", "sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert oracle.differences(spark, name, QUERIES[name], SQL[name], SF) == ""
    else:
        table = "documents"
        assert QUERIES[name](spark, f"{oracle.DATA}/{SF}").count() == spark.read.parquet(f"{oracle.DATA}/{SF}/{table}.parquet").count()
