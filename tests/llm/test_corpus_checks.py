"""Queries that SQL can express, against their SQL; all queries exist."""

import re

import pytest

from vigilog.llm.queries import QUERIES, oracle_sql
from vigilog.plans.check import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, oracle_sql()[name]) is None


def test_one_query_of_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
