from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from palimpsest.operators import references as R

T = lambda day: datetime(2024, 1, day)
REFS = "id string, target string, t timestamp, key string, reason int"
TARGETS = "id string, born timestamp, gone timestamp, found string"


def find(spark, refs, targets, **kw):
    r = R.references(spark.createDataFrame([(*x, "clash", 0) for x in refs], REFS), "t1", "target", "t")
    p = R.parents(spark.createDataFrame([(*x, "clash") for x in targets], TARGETS), "born", F.col("gone"))
    return sorted((x.record_id, x.reason) for x in R.find_orphans(r, p, len(targets), **kw).collect())


ROWS = [("r1", "a", T(5)), ("r2", "zz", T(5)), ("r3", "late", T(5)), ("r4", "gone", T(5)), ("r5", "gone", T(1)), ("r6", None, T(5)), ("r7", "a", None), ("r8", "zz", None), ("r2", "zz", T(5)), (None, "zz", T(5))]
KNOWN = [("a", T(1), None), ("late", T(9), None), ("gone", T(1), T(3)), ("a", T(1), None), (None, T(1), None)]
WANT = [("r2", "missing"), ("r3", "late"), ("r4", "deleted"), ("r8", "missing")]


def test_reasons(spark):
    assert find(spark, ROWS, KNOWN) == WANT


def test_hot_keys_give_the_same(spark):
    assert find(spark, ROWS, KNOWN, hot_rows=1) == WANT
    many = ROWS + [(f"h{i}", "gone", T(5)) for i in range(50)] + [(f"m{i}", "zz", T(5)) for i in range(50)]
    assert find(spark, many, KNOWN, hot_rows=10) == sorted(WANT + [(f"h{i}", "deleted") for i in range(50)] + [(f"m{i}", "missing") for i in range(50)])


def test_false_positives_of_the_filter_are_verified(spark):
    targets = [(f"k{i}", T(1), None) for i in range(3000)]
    refs = [(f"r{i}", f"x{i}", T(2)) for i in range(3000)] + [(f"s{i}", f"k{i}", T(2)) for i in range(3000)]
    r = R.references(spark.createDataFrame([(*x, "c", 0) for x in refs], REFS), "t1", "target", "t")
    p = R.parents(spark.createDataFrame([(*x, "c") for x in targets], TARGETS), "born")
    # A filter sized for one key lets nearly everything through.
    found = R.find_orphans(r, p, 1)
    assert found.count() == 3000 and found.filter("reason = 'missing'").count() == 3000


def test_empty_sides(spark):
    assert find(spark, [], KNOWN) == []
    assert find(spark, [("r", "a", T(1))], []) == [("r", "missing")]


def test_months(spark):
    r = R.references(spark.createDataFrame([(*x, "c", 0) for x in ROWS], REFS), "t1", "target", "t")
    p = R.parents(spark.createDataFrame([(*x, "c") for x in KNOWN], TARGETS), "born", F.col("gone"))
    got = {(x.month, x.reason): x.n_references for x in R.per_month(R.find_orphans(r, p, 3)).collect()}
    assert got == {("2024-01", "missing"): 1, (None, "missing"): 1, ("2024-01", "late"): 1, ("2024-01", "deleted"): 1}
