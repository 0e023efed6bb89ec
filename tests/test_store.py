"""The record store's sequential operators and rules that SQL does not cover."""

from __future__ import annotations

import json
import random

import pytest
from conftest import TINY
from hypothesis import given, settings, strategies as st

from palimpsest.functions import json_text, text
from palimpsest.operators import filters, fusion, graph, paging, segments, snapshot
from palimpsest.plans import records, search


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=900), st.integers(5, 80))
def test_packing_loses_no_word(value, target):
    most = target + 20
    chunks = segments.pack(value, target, most)
    if len(value) > most:
        assert all(len(c) <= most for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(value.split())


def test_cutting_to_tokens():
    assert segments.cut("one two. three four five six seven", 20) == ["one two.", "three four five six", "seven"]
    for value in ("word " * 3000, "x" * 20_000, "", "a\n" * 4000):
        chunks = segments.within_tokens([value])
        assert all(segments.estimate(c) <= segments.MAX_TOKENS for c in chunks)
        assert "".join("".join(chunks).split()) == "".join(value.split())
    # Tokens that are dense at one end.
    dense = "a " * 50 + "b" * 900
    assert all(c.count(" ") < 20 for c in segments.within_tokens([dense], lambda t: t.count(" "), 19))


def test_leaves_and_canonical():
    value = {"a": {"b/c": [1, None, True], "~": "x"}, "e": {}, "f": []}
    assert list(json_text.leaves(value)) == [("$/a/b~1c/0", "1"), ("$/a/b~1c/1", "null"), ("$/a/b~1c/2", "true"), ("$/a/~0", "x")]
    assert json_text.canonical('{ "b":1, "a":[ 2 ] }') == '{"a":[2],"b":1}' and json_text.canonical("{") is None
    assert list(json_text.leaves(5)) == [("$", "5")]


def test_folding_matches_on_columns(spark):
    words = "Šaldytuvo ÀÉÎõü ñ ß Œ 日本が Ążuolas"
    (row,) = spark.createDataFrame([(words,)], "w string").select(text.fold("w").alias("f"), text.tokens("w").alias("t")).collect()
    assert row.f == text.fold_text(words) and row.t[:2] == ["saldytuvo", "aeiou"]


def test_cursor_belongs_to_its_filters():
    cursor = paging.encode([1, "a"], {"k": 1})
    assert paging.decode(cursor, {"k": 1}) == [1, "a"]
    for bad, with_filters in ((cursor, {"k": 2}), ("!!", None)):
        with pytest.raises(ValueError):
            paging.decode(bad, with_filters)


def test_redirect_cycle_raises(spark):
    rows = [("1", "a", "b", 1), ("2", "b", "c", 2), ("3", "c", "a", 3)]
    df = spark.createDataFrame(rows, "id string, source_memory_id string, canonical_memory_id string, s long").selectExpr("*", "timestamp_seconds(s) AS created_at")
    with pytest.raises(ValueError):
        graph.resolve_canonical(df)
    assert {tuple(r) for r in graph.resolve_canonical(df.filter("id <> '3'")).collect()} == {("a", "c", 2), ("b", "c", 1)}


def test_traversal_against_plain_search(spark):
    rng = random.Random(5)
    rows = [(f"l{i:03d}", f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", "rel", rng.randrange(20)) for i in range(70)]
    links = spark.createDataFrame(rows, "link_id string, src string, dst string, relation string, s long").selectExpr("*", "timestamp_seconds(s) AS created_at")
    got = {r.memory_id: (r.depth, r.place, r.via) for r in graph.traverse(graph.directed(links), "n0", 3, 500).collect()}
    seen, frontier = {"n0": (0, 0, None)}, ["n0"]
    for depth in (1, 2, 3):
        after = []
        for node in frontier:
            for link, src, dst, _, _ in sorted(rows, key=lambda r: (r[4], r[0])):
                if node in (src, dst):
                    other = dst if src == node else src
                    if other not in seen:
                        seen[other] = (depth, len(seen), link)
                        after.append(other)
        frontier = after
    assert got == seen
    assert graph.traverse(graph.directed(links), "n0", 3, 7).count() == 7


def test_gate_and_prune(spark):
    row = lambda **k: {"exact_rank": None, "lexical_rank": 1, "semantic_rank": 1, "fused": 1.0} | k
    assert not fusion.needs_rerank([row()], False)
    assert not fusion.needs_rerank([row(exact_rank=1), row()], False)
    assert fusion.needs_rerank([row(), row()], False)
    assert not fusion.needs_rerank([row(fused=1.2), row()], True)
    assert fusion.needs_rerank([row(fused=1.05), row()], True)
    schema = "memory_id string, fused double, reranker double, exact_rank int, first_channel int, first_rank int"
    df = spark.createDataFrame([("a", 0.9, 0.8, None, 1, 1), ("b", 0.5, 0.01, None, 1, 2), ("c", 0.4, None, 1, 0, 1)], schema)
    assert {r.memory_id for r in fusion.prune_decisive(df).collect()} == {"a", "c"}
    close = df.replace(0.01, 0.5, ["reranker"])
    assert fusion.prune_decisive(close).count() == 3


def test_empty_scope_is_nothing(spark):
    assert records._eligible(spark, TINY, spaces=[]).count() == 0
    with pytest.raises(ValueError):
        search.search(records._tables(spark, TINY), filters.Candidates(now=records.NOW), "  ")


def test_stream_equals_batch(spark):
    streamed = {r.segment_id: r.content_hash for r in records.stream_index(spark, TINY).collect()}
    whole = segments.build(records.revisions(spark, TINY, "searchable_text"), "id", "searchable_text")
    assert streamed == {r.segment_id: r.content_hash for r in whole.collect()}


def test_backup_is_whole_or_absent(spark, tmp_path):
    target = str(tmp_path / "copy")
    df = records.memories(spark, TINY)
    snapshot.backup(spark, {"memories": df}, target)
    assert spark.read.parquet(f"{target}/memories.parquet").count() == df.count()
    with pytest.raises(FileExistsError):
        snapshot.backup(spark, {"memories": df}, target)


def test_flatten_edges(spark):
    df = spark.createDataFrame([("a", '{"x":[1,{"y":"z"}]}', "c"), ("b", "{", "c"), ("c", None, "c"), (None, "{}", "c")], "id string, j string, path string")
    assert [(r.record_id, r.path, r.text) for r in json_text.flatten(df, "id", "j").orderBy("position").collect()] == [("a", "$/x/0", "1"), ("a", "$/x/1/y", "z")]
    assert json.loads(json_text.canonical('"x"')) == "x"
