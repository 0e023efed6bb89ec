"""Write commands, whole records, the index, traversal pages and checks on small cases."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import TINY
from pyspark.sql import functions as F

from palimpsest.operators import commands, graph, hydrate, lexical, postings, projection, snapshot, traversal, validate
from palimpsest.plans import records, search
from palimpsest.sources.tables import read

T = lambda day: datetime(2024, 1, day)


def test_index_scores_as_the_scan_does(spark):
    texts = ["red-hot iron", "hot red iron iron", "Red hot red hot", "", None, "šalta red"]
    df = spark.createDataFrame([(f"d{i}", t, "red" if i == 3 else None) for i, t in enumerate(texts)] + [("d0", texts[0], None)], "id string, text string, title string")
    index = postings.build(df, ["title", "text"])
    once = df.dropDuplicates(["id"])
    for q in ("red", "red-hot iron", "salta nothing", "hot-red-hot"):
        want = {r.id: round(r.score, 9) for r in lexical.bm25(once, {"title": 2.0, "text": 1.0}, q).collect()}
        assert {r.id: round(r.score, 9) for r in postings.search(index, [2.0, 1.0], q).collect()} == want and (want or q == "salta nothing")
    assert postings.search(index, [2.0, 1.0], " - ").count() == 0
    empty = postings.build(df.limit(0), ["title", "text"])
    assert postings.search(empty, [2.0, 1.0], "red").count() == 0


SOURCE = "array<struct<uri string, label string, type string, observed_at timestamp, metadata string>>"


def test_fields_and_segments(spark):
    rows = [
        ("a", "T", None, ["x"], '{"b/c": [1, {"d": null}], "e": {}}', '{"k": "v"}', [("u", "", None, T(1), '{"m": 2}'), None]),
        ("b", None, None, None, "{bad", None, None), ("c", None, None, [], '{"long": "' + "word " * 2000 + '"}', "null", []), (None, "n", None, [], "{}", "{}", []),
    ]
    df = spark.createDataFrame(rows, f"id string, title string, kind string, tags array<string>, content_json string, metadata_json string, sources {SOURCE}")
    got = [(r.record_id, r.path, r.text) for r in projection.fields(df).orderBy("record_id", "ordinal").collect()]
    assert got[:6] == [("a", "$/b~1c/0", "1"), ("a", "$/b~1c/1/d", "null"), ("a", "metadata/k", "v"), ("a", "sources/0/uri", "u"), ("a", "sources/0/observedAt", "2024-01-01T00:00:00.000Z"), ("a", "sources/0/metadata/m", "2")]
    built = projection.field_segments(df)
    texts = {(r.record_id, r.ordinal): r.text for r in built.collect()}
    assert texts[("a", 0)] == "Title: T\nTags: x\n$/b~1c/0: 1" and texts[("b", 0)] == "$: "
    assert [r.segment_id for r in projection.of_record(built, "c").collect()] == [f"c:{i}" for i in range(sum(k[0] == "c" for k in texts))]
    assert {r.record_id for r in projection.first_segments(built).collect()} == {"a", "b", "c"}
    assert [r[0] for r in df.filter("id = 'a'").select(F.explode(projection.source_lines("sources"))).collect()] == ["sources/0/uri: u", "sources/0/observedAt: 2024-01-01T00:00:00.000Z"]


def test_point_read_raises(spark):
    r, e = records.delivered(spark, TINY), read(spark, TINY, "memory_state_events")
    known = r.join(e, "memory_id", "left_semi").first()["memory_id"]
    assert hydrate.point_read(r, e, known).count() == 1
    for how in ({"memory": "none"}, {"memory": known, "revision": "none"}, {"memory": known, "at": "1990-01-01"}):
        with pytest.raises(LookupError):
            hydrate.point_read(r, e, **how)


def test_creation(spark):
    old = spark.createDataFrame([("m1", "s", "k1", "l1"), ("m2", "s", None, None)], "id string, space_id string, idempotency_key string, logical_key string")
    asked = [("c1", T(1), "s", "k1", None), ("c2", T(1), "s", None, "l1"), ("c3", T(2), "s", "k3", "l3"), ("c4", T(3), "s", "k3", "l4"), ("c5", T(4), "s", None, "l3"), ("c6", T(5), "t", "k1", "l1"), ("c7", None, None, None, None), ("c8", T(6), "s", None, None)]
    c = spark.createDataFrame(asked, "command_id string, arrival timestamp, space_id string, idempotency_key string, logical_key string")
    got = commands.create(old, c)
    assert {r.command_id: r.outcome for r in got.collect()} == {"c1": "repeated", "c2": "conflict", "c3": "created", "c4": "repeated", "c5": "conflict", "c6": "created", "c7": "created", "c8": "created"}
    assert got.filter("outcome = 'created'").select("memory_id").distinct().count() == 4
    assert commands.create(old.limit(0), c.limit(0)).count() == 0


def test_feedback_with_earlier_rows(spark):
    r = spark.createDataFrame([("r1", "m"), ("r2", "m"), ("x", "n")], "id string, memory_id string")
    heads = spark.createDataFrame([("r2", "m"), ("x", "n")], "id string, memory_id string")
    schema = "command_id string, arrival timestamp, memory_id string, revision_id string, scope string, signal string, query string, idempotency_key string"
    first = spark.createDataFrame([("a", T(1), "m", None, "content", "correct", None, "k")], schema)
    none = spark.createDataFrame([], "memory_id string, idempotency_key string, request_hash string")
    done = commands.record_feedback(none, r, heads, first)
    assert [(x.revision_id, x.outcome) for x in done.collect()] == [("r2", "recorded")]
    later = [
        ("b", T(2), "m", None, "content", "correct", None, "k"), ("c", T(2), "m", "r1", "content", "correct", None, "k"), ("d", T(2), "m", "x", "content", "correct", None, None), ("e", T(2), "m", None, "content", "correct", "q", None),
        ("f", T(2), "m", None, "retrieval", "helpful", "q", None), ("g", T(2), "m", "r1", "retrieval", "helpful", "q", None), ("h", T(2), "m", "r1", "retrieval", "helpful", " ", None), ("i", T(2), None, None, None, None, None, None), ("j", T(2), "gone", None, "content", "stale", None, None),
    ]
    got = {x.command_id: x.outcome for x in commands.record_feedback(done, r, heads, spark.createDataFrame(later, schema)).collect()}
    assert got == {"b": "repeated", "c": "conflict", "d": "unknown", "e": "invalid", "f": "invalid", "g": "recorded", "h": "invalid", "i": "invalid", "j": "unknown"}


def test_merges_are_whole(spark):
    heads = spark.createDataFrame([(f"r{i}", f"m{i}") for i in range(6)], "id string, memory_id string")
    m = spark.createDataFrame([(f"m{i}", "t" if i == 5 else "s", "archived" if i == 3 else "active") for i in range(6)], "id string, space_id string, state string")
    red = spark.createDataFrame([("e", "old", "m1", T(1))], "id string, source_memory_id string, canonical_memory_id string, created_at timestamp")
    row = lambda op, day, c, d, cr=None, dr=None: (op, T(day), f"m{c}", cr or f"r{c}", f"m{d}", dr or f"r{d}")
    asked = [row("a", 1, 0, 1), row("a", 1, 0, 3), row("b", 2, 2, 1), row("c", 3, 1, 4), row("d", 1, 2, 5), row("e", 1, 4, 4), row("f", 1, 4, 2, dr="old"), row("a", 1, 0, 1)]
    ops = spark.createDataFrame(asked, "operation_id string, arrival timestamp, canonical_id string, canonical_revision_id string, duplicate_id string, duplicate_revision_id string")
    done = commands.merge(heads, m, red, ops)
    assert {(r.operation_id, r.outcome) for r in done.collect()} == {("a", "applied"), ("b", "rejected"), ("c", "rejected"), ("d", "rejected"), ("e", "rejected"), ("f", "rejected")}
    events = spark.createDataFrame([("m1", 4, T(9))], "memory_id string, event_number int, recorded_at timestamp")
    rows = commands.merge_rows(done, red, events)
    assert {(r.source_memory_id, r.canonical_memory_id, r.direct) for r in rows["redirects"].collect()} == {("m1", "m0", True), ("m3", "m0", True), ("old", "m0", False)}
    assert [(r.memory_id, r.event_number, r.recorded_at) for r in rows["events"].collect()] == [("m1", 5, datetime(2024, 1, 9, 0, 0, 0, 1000))]


def test_spaces_and_cascade(spark):
    s = spark.createDataFrame([("default", "D", T(1), None), ("a", "A", T(1), T(2)), ("b", "B", T(1), None)], "id string, name string, created_at timestamp, deleted_at timestamp")
    asked = [("1", T(3), "default", "delete"), ("2", T(3), "a", "delete"), ("3", T(3), "b", "delete"), ("4", T(4), "b", "restore"), ("5", T(3), "new", "create"), ("6", T(3), "a", "create"), ("7", T(5), "new", "delete"), ("8", T(5), None, "other")]
    c = spark.createDataFrame(asked, "command_id string, arrival timestamp, space_id string, action string")
    assert {r.id: r.deleted_at for r in commands.change_spaces(s, c).collect()} == {"default": None, "a": T(2), "b": None, "new": T(5)}
    links = spark.createDataFrame([("m", "n"), ("n", "o"), ("o", None)], "src string, dst string")
    gone = spark.createDataFrame([("m",), (None,), ("m",)], "memory_id string")
    left = commands.cascade({"links": links}, gone)["links"]
    assert {tuple(r) for r in left.select("src", "dst").collect()} == {("n", "o"), ("o", None)}


def test_traversal_pages_and_ranks(spark):
    links = spark.createDataFrame([(f"l{i}", "a", f"n{i}", "R", T(i + 1)) for i in range(9)], "link_id string, src string, dst string, relation string, created_at timestamp")
    walked = graph.traverse(graph.directed(links), "a", 2, 100)
    rows, cursor, at = traversal.page(walked, {"q": 1}, "2024-02-01", 4)
    assert [r.memory_id for r in rows.orderBy("place").collect()] == ["a", "n0", "n1", "n2"]
    rows, _, again = traversal.page(walked, {"q": 1}, None, 4, cursor)
    assert again == at and [r.memory_id for r in rows.orderBy("place").collect()] == ["n3", "n4", "n5", "n6"]
    for bad in ({"filters": {"q": 2}, "at": None}, {"filters": {"q": 1}, "at": "2024-03-01"}):
        with pytest.raises(ValueError):
            traversal.page(walked, bad["filters"], bad["at"], 4, cursor)
    texts = spark.createDataFrame([("n7", "the retention plan", None, None), ("a", None, None, None)], "memory_id string, searchable_text string, salience double, confidence double")
    best = traversal.ranked(walked, texts, "retention plan").orderBy("place").collect()
    assert [r.memory_id for r in best[:3]] == ["a", "n7", "n0"]


def test_search_modes(spark):
    t = records._tables(spark, TINY)
    from palimpsest.operators.filters import Candidates

    wanted = Candidates(now=records.NOW)
    found = search.search(t, wanted, "retention", mode="quality")
    assert {r.degraded for r in found.collect()} <= {"no vectors; no reranker", "no vectors"}
    for bad in ({"query": " "}, {"query": "x", "mode": "best"}):
        with pytest.raises(ValueError):
            search.search(t, wanted, **bad)


def test_checks(spark, tmp_path):
    assert validate.problems("search", {"query": "x", "k": 5, "tags": ["a"]}) == []
    assert sorted(validate.problems("search", {"k": 51, "mode": "best", "tags": ["a", 5], "other": 1, "expand": 1, "at": T(1)})) == ["expand: wrong type", "k: not between 1 and 50", "mode: none of auto, fast, quality, lexical, semantic", "other: unknown", "query: missing", "tags: item 1 wrong type"]
    assert validate.problems("revise", {"memory_id": "x", "expected_revision_id": True, "content_json": "{}"}) == ["memory_id: wrong form", "expected_revision_id: wrong type"]
    assert validate.problems("status", {"details": True}) == [] and validate.problems("delete", {"memory_id": None}) == ["memory_id: missing"]
    assert validate.parts_of(validate.address("a/b", "m é", True)) == ("a/b", "m é", True)
    with pytest.raises(ValueError):
        validate.parts_of("memory://spaces/a")
    with pytest.raises(ValueError):
        validate.check_range(T(2), T(2))
    assert validate.load_settings({"PALIMPSEST_EMBED_BATCH": "16", "PALIMPSEST_MODELS_ENABLED": "false"}) == validate.Settings(embed_batch=16, models_enabled=False)
    with pytest.raises(ValueError):
        validate.load_settings({"PALIMPSEST_EMBED_BATCH": "-1"})
    s = spark.createDataFrame([("a", None), ("b", T(1))], "id string, deleted_at timestamp")
    validate.check_space(s, "a")
    for bad in ("b", "c"):
        with pytest.raises(LookupError):
            validate.check_space(s, bad)
    assert validate.check_table(s, "id string") is s
    with pytest.raises(TypeError):
        validate.check_table(s, "id int")
    ran = []
    step = lambda session, folder: ran.append(folder)
    assert validate.migrate(spark, f"file://{tmp_path}/m", {1: step, 2: step}, 2) == 2 and validate.migrate(spark, f"file://{tmp_path}/m", {}, 2) == 2 and len(ran) == 2
    with pytest.raises(ValueError):
        validate.migrate(spark, f"file://{tmp_path}/m", {}, 1)


def test_backup_and_restore(spark, tmp_path):
    base = f"file://{tmp_path}"
    snapshot.backup(spark, {"t": spark.range(3)}, f"{base}/saved")
    with pytest.raises(FileExistsError):
        snapshot.backup(spark, {"t": spark.range(1)}, f"{base}/saved")
    assert snapshot.restore(spark, f"{base}/saved", f"{base}/live") is None
    kept = snapshot.restore(spark, f"{base}/saved", f"{base}/live")
    assert spark.read.parquet(f"{base}/live/t.parquet").count() == 3 and spark.read.parquet(f"{kept}/t.parquet").count() == 3
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]
