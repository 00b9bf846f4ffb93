"""Every registered query against its DuckDB twin; those without one must run."""

from __future__ import annotations

import pytest
from conftest import SMALL
from helpers import compare

from vellumix.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, con, name):
    assert compare(spark, con, SMALL, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
