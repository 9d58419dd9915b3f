"""The operators' queries against their SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

from palimp.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from test_sql import con, same_rows  # noqa: E402, F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_sql(spark, con, name):  # noqa: F811
    same_rows(spark, con, queries.QUERIES[name], queries.ORACLES[name])
