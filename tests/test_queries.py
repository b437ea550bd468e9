"""Registered queries against their SQL statements on the smallest data folder."""

from pathlib import Path

import pytest

from oracles import STATEMENTS
from scimetrics.registry import QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
# their operators are checked against brute force in test_graph.py
ITERATIVE = {
    "net_pagerank",
    "net_eigen",
    "net_hits",
    "net_community",
    "net_closeness",
    "net_eccentricity",
    "net_summary",
    "net_betweenness",
}


def test_every_statement_has_a_query():
    assert set(STATEMENTS) == set(QUERIES)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(set(STATEMENTS) - ITERATIVE))
def test_query_equals_statement(spark, name):
    assert difference(spark, connect(FOLDER), name, FOLDER) is None
