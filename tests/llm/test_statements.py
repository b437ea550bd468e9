"""Operators that SQL can state, against their SQL in DuckDB."""

import pytest

from scimetrics.llm.statements import STATEMENTS
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_statement(spark, name):
    assert difference(spark, connect(FOLDER), name, FOLDER) is None
