from __future__ import annotations

import pytest
from compare import differences, duck
from conftest import TINY

from palimpsest.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    wrong, *_ = differences(spark, duck(TINY), queries.QUERIES[name], queries.SQL[name], TINY)
    assert wrong is None


def test_p1_pieces_of_the_table(spark):
    limits = queries._limits(spark, TINY)
    for r in queries.p1_pieces(spark, TINY).collect():
        assert len(r.text) == r.end_char - r.start_char <= limits[r.field][0]
