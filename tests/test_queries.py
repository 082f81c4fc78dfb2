"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from tests.compare import rows_of, sql_rows
from wayside.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck, sf):
    assert rows_of(QUERIES[name](spark, sf)) == sql_rows(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_not_need_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "wayside"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            text = p.read_text()
            assert ".llm" not in text and "import llm" not in text, p
