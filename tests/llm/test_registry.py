from __future__ import annotations

import pytest

from sparkloupe.llm.registry import ORACLES, QUERIES
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    said = compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name])
    assert said is None, said


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
