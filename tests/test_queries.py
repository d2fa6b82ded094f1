"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from sparkloupe.queries import ORACLES, QUERIES

from .compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        said = compare(spark, SMALL, QUERIES[name], ORACLES[name])
        assert said is None, said
    else:
        QUERIES[name](spark, SMALL).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
