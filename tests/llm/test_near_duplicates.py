from __future__ import annotations

import random
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from conftest import SMALL

from palimpsest.llm import near_duplicates as N, queries

WORD = re.compile(r"[^\W_]+")


def brute(rows, threshold=Fraction(7, 10), width=3):
    sets = {}
    for i, t in rows:
        if i is not None and t is not None:
            w = WORD.findall(t.lower())
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    met = {(a, b) for own in lists.values() for a in own for b in own if a < b}
    return {(a, b) for a, b in met if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= threshold}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "id string, text string, did int, h1 string")


def pairs(found):
    rows = [tuple(r) for r in found.text_pairs().collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def edited(seed, n=60):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.choice([3, 4, 8, 30, 90]))]
        rows.append((f"a{i:03d}", " ".join(words)))
        for j in range(rng.randrange(3)):
            changed = list(words)
            for _ in range(rng.randrange(1 + len(words) // 8)):
                changed[rng.randrange(len(changed))] = rng.choice(common)
            rows.append((f"b{i:03d}{j}", ", ".join(changed).upper()))
    return rows


@pytest.mark.parametrize("threshold,width", [(Fraction(7, 10), 3), (Fraction(4, 5), 5)])
def test_edited_copies(spark, threshold, width):
    rows = edited(1)
    assert pairs(N.NearDuplicates(frame(spark, rows), "id", "text", threshold, width)) == brute(rows, threshold, width)


def test_common_shingles_do_not_hide_pairs(spark):
    rng = random.Random(3)
    head = " ".join(f"h{i}" for i in range(40))
    rows = [(f"t{i:03d}", head + " " + " ".join(str(rng.randrange(10**6)) for _ in range(rng.choice([4, 8, 60])))) for i in range(60)]
    assert pairs(N.NearDuplicates(frame(spark, rows), "id", "text", Fraction(7, 10), 3)) == brute(rows)


def test_bounded_frequent_table_changes_nothing(spark, monkeypatch):
    rows = edited(4)
    monkeypatch.setattr(N, "MAX_FREQUENT", 3)
    assert pairs(N.NearDuplicates(frame(spark, rows), "id", "text", Fraction(7, 10), 3)) == brute(rows)


def test_edges(spark):
    rows = [("a", "one two three four"), ("b", "One, two; three FOUR!"), ("a", "one two three four"), ("c", None), (None, "one two three four"), ("d", ""), ("e", ""), ("f", "one two"), ("g", "one two"), ("h", "one two three four")]
    found = N.NearDuplicates(frame(spark, rows), "id", "text", Fraction(7, 10), 3)
    assert pairs(found) == {("a", "b"), ("a", "h"), ("b", "h")}
    groups = {r.id: (r.group_id, r.n_links) for r in found.groups().collect()}
    assert groups == {"a": ("a", 1), "b": ("a", 1), "h": ("a", 1)}
    none = N.NearDuplicates(frame(spark, []), "id", "text", Fraction(7, 10), 3)
    assert none.text_pairs().count() == 0 and none.groups().count() == 0


def test_very_long_text(spark):
    long = " ".join(str(i) for i in range(60_000))
    assert pairs(N.NearDuplicates(frame(spark, [("a", long), ("b", long + " more"), ("c", "x y z")]), "id", "text", Fraction(7, 10), 3)) == {("a", "b")}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.label for r in N.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_whole_table_against_brute_force(spark):
    rows = duckdb.connect().execute(f"SELECT DISTINCT id, searchable_text FROM '{SMALL}/memory_revisions.parquet'").fetchall()
    got = {tuple(r) for r in queries.p5_found(spark, SMALL).collect()}
    assert got == brute(rows)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows = edited(5, 40) + [(f"c{i:02d}", "one two three four five six") for i in range(23)]
    want = brute(rows)
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "LEAST_FREQUENT", 4)
    assert pairs(N.NearDuplicates(frame(spark, rows), "id", "text", Fraction(7, 10), 3)) == want
