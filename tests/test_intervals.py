from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import intervals

START = datetime(2024, 1, 1)
SCHEMA = "k string, a timestamp, b timestamp, entity int, s string"


def brute(rows):
    """(gaps, periods) by entity, in seconds; None is unbounded."""
    inf = float("inf")
    gaps, periods = set(), set()
    for k in {r[0] for r in rows if r[0] is not None}:
        own = sorted({(-inf if a is None else a, inf if b is None else b) for kk, a, b in rows if kk == k})
        own = [(a, b) for a, b in own if a < b]
        merged = []
        for a, b in own:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        periods |= {(k, None if a == -inf else a, None if b == inf else b) for a, b in merged}
        gaps |= {(k, x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return gaps, periods


def us(seconds):
    return None if seconds is None else int((START + timedelta(seconds=seconds) - datetime(1970, 1, 1)).total_seconds() * 1e6)


def frame(spark, rows):
    at = lambda x: None if x is None else START + timedelta(seconds=x)
    return spark.createDataFrame([(k, at(a), at(b), 1, "x") for k, a, b in rows], SCHEMA)


@pytest.mark.parametrize("seed,shard_rows", [(1, 1_000_000), (2, 10), (3, 3), (4, 25)])
def test_random_against_brute_force(spark, seed, shard_rows):
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        a = rng.choice([None, rng.randrange(300)]) if rng.random() < 0.1 else rng.randrange(300)
        b = None if rng.random() < 0.03 else (a or 0) + rng.choice([-3, 0, 1, 2, 5, 40, 200])
        rows.append((rng.choice(["hot"] * 5 + list("abcdefgh") + [None]), a, b))
    rows += rows[:20]
    df = frame(spark, rows)
    gaps, periods = brute(rows)
    got = {tuple(r) for r in intervals.find_gaps(df, "k", "a", "b", shard_rows).collect()}
    assert got == {(k, us(a), us(b)) for k, a, b in gaps}
    got = [tuple(r) for r in intervals.find_periods(df, "k", "a", "b", shard_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, us(a), us(b)) for k, a, b in periods}


@pytest.mark.parametrize("shard_rows", [1, 1_000_000])
def test_cover_of_many_shards_hides_their_gaps(spark, shard_rows):
    rows = [("x", 0, 1000), *[("x", i * 100, i * 100 + 10) for i in range(9)], ("x", 1500, 1600)]
    got = {tuple(r) for r in intervals.find_gaps(frame(spark, rows), "k", "a", "b", shard_rows).collect()}
    assert got == {("x", us(1000), us(1500))}


def test_empty_touching_and_empty_intervals(spark):
    assert intervals.find_gaps(frame(spark, []), "k", "a", "b").count() == 0
    assert intervals.find_periods(frame(spark, []), "k", "a", "b", 1).count() == 0
    rows = [("x", 0, 5), ("x", 5, 9), ("y", 4, 4), ("y", 9, 2)]
    assert intervals.find_gaps(frame(spark, rows), "k", "a", "b").count() == 0
    assert [tuple(r) for r in intervals.find_periods(frame(spark, rows), "k", "a", "b").collect()] == [("x", us(0), us(9))]


def test_edges_follow_the_rows(spark):
    df = frame(spark, [("x", i, i + 1) for i in range(1000)])
    edges = intervals.shard_edges(df, "a", 100)
    assert 8 <= len(edges) <= 9 and edges == sorted(edges)
    assert df.select(F.col("a")).count() == 1000
