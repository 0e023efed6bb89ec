from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL

from palimpsest.llm import knn, queries, router

SCHEMA = "segment_id string, model_profile_id string, embedding array<float>, rid int, vec string"


def brute(rows, k=5, dim=64):
    best = {}
    for seg, profile, e in rows:
        if seg is None or profile is None or e is None or len(e) != dim or any(x is None for x in e):
            continue
        x = np.array(e, dtype=np.float32)
        if np.isfinite(x).all() and x.any():
            best[seg] = (profile, x.astype(np.float64))
    out = set()
    for seg, (profile, x) in best.items():
        others = sorted((((x - y) ** 2).sum(), s) for s, (p, y) in best.items() if p == profile and s != seg)
        out |= {(seg, s) for _, s in others[:k]}
    return out


def vectors(n, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    return [(f"s{i:05d}", "p" if i % 4 else "q", [float(v) for v in (centres[rng.integers(len(centres))] + 0.1 * rng.normal(size=dim)).astype(np.float32)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)


def found(df):
    return {(r.segment_id, r.neighbour_id) for r in df.collect()}


def test_copies_ties_and_unusable_vectors(spark):
    rows = vectors(60)
    rows += [(f"c{i}", "p", rows[1][2]) for i in range(9)]  # more copies than neighbours
    rows += [("d0", "p", rows[2][2]), rows[3], rows[3]]
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0] * 32, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows += [(f"bad{i}", "p", b) for i, b in enumerate(bad)] + [(None, "p", [1.0] * 64), ("x", None, [1.0] * 64), ("alone", "r", [1.0] * 64)]
    assert found(knn.nearest(frame(spark, rows))) == brute(rows)


def test_equal_distances_go_by_segment(spark):
    axis = lambda i, v: [v if j == i else 0.0 for j in range(64)]
    rows = [(f"z{i:02d}", "p", axis(i, 1.0)) for i in range(40)]
    assert found(knn.nearest(frame(spark, rows))) == brute(rows)


def test_blocks_do_not_change_the_result(spark):
    rows = vectors(200, 3)
    assert found(knn.nearest(frame(spark, rows), block=30)) == brute(rows)


def test_partitions_reach_the_neighbours(spark):
    rows = vectors(1500, 5)
    want = brute(rows)
    got = found(knn.nearest(frame(spark, rows), part_rows=200, block=128))
    assert len(got & want) / len(want) > 0.95


def test_empty(spark):
    assert knn.pairs(knn.nearest(frame(spark, []))).count() == 0


def test_report(spark):
    (row,) = queries.p4_recall(spark, SMALL).collect()
    assert row.n_queries > 0 and row.recall >= 0.9


@pytest.mark.parametrize("parts", [2, 7, 16])
def test_partition_is_balanced(parts):
    x = np.random.default_rng(1).normal(size=(1600, 16)).astype(np.float32)
    labels = router.partition_graph(x, router.neighbour_graph(x, 10), parts)
    sizes = np.bincount(labels, minlength=parts)
    assert sizes.min() > 0 and sizes.max() <= np.ceil(router.SLACK * 1600 / parts)


def test_router_survives_storage():
    x = np.random.default_rng(2).normal(size=(400, 16)).astype(np.float32)
    r = router.fit(x, 4)
    again = router.Router.load(r.dump())
    assert np.array_equal(router.routes(r, x, 3, 0.99), router.routes(again, x, 3, 0.99))


@pytest.mark.parametrize("offset", [0.0, 100.0, 300.0])
def test_vectors_far_from_the_origin(offset):
    x = (offset + np.random.default_rng(3).normal(scale=0.05, size=(1000, 64))).astype(np.float32)
    ids = np.arange(len(x))
    i, j, _ = knn.nearest_in_block(ids, x, ids, x, 5)
    wide = x.astype(np.float64)
    for row in range(0, 1000, 97):
        d = ((wide - wide[row]) ** 2).sum(1)
        d[row] = np.inf
        assert set(j[i == row]) == set(np.lexsort((ids, d))[:5])


def test_a_tight_cluster_is_compared_whole():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(50, 64)) * 1e4, 1.0 + 1e-6 * rng.normal(size=(60, 64))]).astype(np.float32)
    ids = np.arange(len(x))
    i, j, _ = knn.nearest_in_block(ids, x, ids, x, 5)
    wide = x.astype(np.float64)
    for row in range(50, 110, 7):
        d = ((wide - wide[row]) ** 2).sum(1)
        d[row] = np.inf
        assert set(j[i == row]) == set(np.lexsort((ids, d))[:5])


def test_large_partitions_are_partitioned_again(spark):
    rows = vectors(2400, 6)
    want = brute(rows)
    got = found(knn.nearest(frame(spark, rows), part_rows=60, max_parts=3))
    assert len(got & want) / len(want) > 0.9
