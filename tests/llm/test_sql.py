"""Queries of the training-text package against their SQL, on the smallest tables."""

import pytest

from tests.compare import rows_of, sql_rows
from wayside.llm.oracles import ORACLES
from wayside.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck, sf):
    assert rows_of(QUERIES[name](spark, sf)) == sql_rows(duck, ORACLES[name])
