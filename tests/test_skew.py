from __future__ import annotations

import pytest

from palimpsest.operators.skew import join_unique


@pytest.mark.parametrize("hot_rows", [1, 5, 1000])
def test_hot_keys_join_as_others(spark, hot_rows):
    many = spark.createDataFrame([("h", i) for i in range(20)] + [("a", 100), ("b", 101), (None, 102), ("zz", 103)], "k string, v int")
    one = spark.createDataFrame([("h", "H"), ("a", "A"), ("b", "B"), ("c", "C"), (None, "N")], "k string, w string")
    got = sorted((r.k, r.v, r.w) for r in join_unique(many, one, ["k"], hot_rows).collect())
    assert got == sorted([("h", i, "H") for i in range(20)] + [("a", 100, "A"), ("b", 101, "B")])
    assert join_unique(many.limit(0), one, ["k"]).count() == 0
