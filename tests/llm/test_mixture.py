from __future__ import annotations

import pytest
from conftest import TINY

from palimpsest.llm import mixture, queries

DOCS = "doc_id long, source string, text string, key int, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int, available int"


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, 1, "c") for x in docs], DOCS)
    t = spark.createDataFrame([(*x, 1) for x in targets], TARGETS)
    mixed, report = mixture.mix(d, t, **kw)
    return mixed.collect(), {r.source: r for r in report.collect()}


def docs(source, n, words, first=0):
    return [(first + i, source, "word " * words) for i in range(n)]


def test_shares_and_repeats(spark):
    mixed, report = mix(spark, docs("big", 400, 10) + docs("small", 20, 10, 1000) + docs("other", 50, 5, 2000), [("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.0, 2)])
    assert all(r.times_used <= (3 if r.source == "small" else 1) for r in mixed)
    assert {r.source for r in mixed} == {"big", "small"} and len({r.doc_id for r in mixed}) == len(mixed)
    assert all(r.times_used == 3 for r in mixed if r.source == "small")
    assert report["big"].actual_share == pytest.approx(0.5, abs=0.02) and report["other"].actual_share == 0
    assert report["absent"].available_tokens == 0 and sum(r.used_tokens for r in report.values()) == sum(r.n_tokens * r.times_used for r in mixed)


def test_source_without_documents_does_not_hold_back(spark):
    mixed, report = mix(spark, docs("a", 10, 3) + docs("b", 10, 3, 100), [("a", 0.4, 1), ("b", 0.2, 1), ("gone", 0.4, 5)])
    assert report["a"].used_documents == 10 and report["b"].used_documents == 5 and report["gone"].used_tokens == 0


def test_edges(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, None, "word"), (4, "a", "word word"), (4, "a", "word word"), (None, "a", "word")]
    mixed, report = mix(spark, rows, [("a", 1.0, 2), (None, 0.5, 1), ("n", None, None)])
    assert [(r.doc_id, r.times_used) for r in mixed] == [(4, 2)] and report["a"].actual_share == 1.0 and report[None].used_tokens == 0
    assert mix(spark, [], [("a", 1.0, 1)])[0] == [] and mix(spark, rows, [])[0] == []
    assert mix(spark, [], [])[1] == {}


def test_prefix_sums_equal_plain_sums(spark):
    rows = [(i, "s", "word " * (1 + i % 7)) for i in range(300)]
    mixed, report = mix(spark, rows, [("s", 1.0, 1)], total_tokens=400)
    used = sum(r.n_tokens for r in mixed)
    assert abs(used - 400) <= 4 and report["s"].used_tokens == used


def test_table_shares(spark):
    report = queries.p8_shares(spark, TINY).collect()
    assert sum(r.actual_share for r in report) == pytest.approx(1.0)
    known = sum(r.target_share for r in report if r.available_tokens > 0)
    for r in report:
        if r.available_tokens and r.used_documents >= 5:
            assert r.actual_share == pytest.approx(r.target_share / known, rel=0.5)
