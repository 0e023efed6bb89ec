from __future__ import annotations

import json

import pytest
from conftest import TINY
from pyspark.sql import functions as F

from palimpsest.operators import models, shape
from palimpsest.plans import records, search
from palimpsest.streaming import generations

TEXT = "Title: T\nKind: note\n$/price/amount: 18.25\n$/price/currency: EUR\n$/price/basis: each\n$/other: x"


def excerpt(spark, path, fallback, **kw):
    df = spark.createDataFrame([("a", TEXT, path, fallback)], "id string, t string, p string, f string")
    return shape.with_excerpt(df, "id", "t", "p", "f", **kw).first().excerpt


def test_excerpt_takes_the_nearest_siblings(spark):
    assert excerpt(spark, "$/price/currency", "f") == "Title: T\nKind: note\n$/price/amount: 18.25\n$/price/currency: EUR\n$/price/basis: each"
    assert excerpt(spark, "$/price/amount", "f", most=70) == "Title: T\nKind: note\n$/price/amount: 18.25\n$/price/currency: EUR"
    assert excerpt(spark, "$/gone", "fallback text", most=8) == "fallback"
    assert excerpt(spark, "$/price/basis", "f", most=10) == "f"
    assert excerpt(spark, None, None) == ""


def test_excerpts_and_documents_on_rows(spark):
    r = records.revisions(spark, TINY).limit(20)
    shown = shape.with_excerpt(r.withColumn("path", F.lit("$/x")), "id", "searchable_text", "path", "title")
    assert all(x.excerpt == (x.title or "")[: shape.EXCERPT] for x in shown.collect())
    for x in r.withColumn("d", shape.rerank_document(F.col("searchable_text"))).collect():
        assert "Matched evidence:" in x.d and len(x.d) <= shape.RERANK_DOCUMENT and ("Title: " in x.d) == bool(x.title or "Title: " in x.searchable_text)


def test_compact_drops_what_is_empty(spark):
    df = spark.createDataFrame([("a", "", None, []), ("b", "x", 1, ["t"])], "id string, s string, n int, tags array<string>")
    got = [json.loads(r[0]) for r in df.select(shape.compact(df.columns, df.schema)).collect()]
    assert got == [{"id": "a"}, {"id": "b", "s": "x", "n": 1, "tags": ["t"]}]


def test_generation_is_resumed_and_published_whole(spark, tmp_path):
    base, embedder = f"file://{tmp_path}/index", models.HashingEmbedder(16)
    df = spark.createDataFrame([(f"s{i}", f"word{i} other") for i in range(9)] + [("n", None)], "segment_id string, text string")
    texts = df.filter("text IS NOT NULL")
    assert generations.current(spark, base) is None
    assert generations.build(df.limit(4), embedder, base) == 4
    with pytest.raises(ValueError):
        generations.publish(texts, embedder, base)
    assert generations.build(df, embedder, base) == 9 and generations.build(df, embedder, base) == 9
    assert generations.publish(texts, embedder, base) == embedder.profile.id
    assert generations.publish(texts, embedder, base) == embedder.profile.id
    assert generations.current(spark, base).count() == 9
    assert models.Profile("hashing", "1", 32).id != embedder.profile.id


def picky():
    # Local, so that workers get the class itself.
    class Picky(models.HashingEmbedder):
        def embed_documents(self, texts):
            if "bad" in texts:
                raise ValueError("refused")
            return models.HashingEmbedder.embed_documents(self, texts)

    return Picky(8)


def test_one_text_costs_no_other_its_vector(spark):
    df = spark.createDataFrame([(f"s{i}", "r1" if i < 10 else "r2", t) for i, t in enumerate(["good"] * 9 + ["bad"] + ["fine", "", None] * 4)], "segment_id string, record_id string, text string")
    got = models.embed_each(df, "segment_id", "text", picky())
    rows = {r.segment_id: r for r in got.collect()}
    assert len(rows) == 18 and [k for k, r in rows.items() if r.embedding is None] == ["s9"] and rows["s9"].error == "refused"
    assert {tuple(r) for r in models.index_status(df.filter("text IS NOT NULL"), got).collect()} == {("r1", "lexical-only", 10, "refused"), ("r2", "ready", 8, None)}
    assert models.embed(df.limit(0), "segment_id", "text", picky()).count() == 0
    assert {r.id: r.n_tokens for r in models.count_tokens(df, "segment_id", "text", picky()).collect()}["s12"] == 0


def test_batches_and_breaker():
    assert models.micro_batches(["aa"] * 5, 2) == [(0, 2), (2, 4), (4, 5)] and models.micro_batches([], 2) == []
    assert models.micro_batches(["a" * 9, "a", "a", "a" * 9], 4, 3) == [(0, 1), (1, 3), (3, 4)]
    now, broken = [0.0], models.Breaker(lambda: now[0])
    for _ in range(3):
        with pytest.raises(ZeroDivisionError):
            broken.call(lambda: 1 / 0)
    with pytest.raises(RuntimeError):
        broken.call(lambda: 1)
    now[0] = 31.0
    assert broken.call(lambda: 1) == 1
    for bad in ([[1.0]], [[float("nan")] * 2], [[1.0, 2.0]] * 2):
        with pytest.raises(ValueError):
            models.checked(bad, 1, 2)
    assert models.warm(models.HashingEmbedder(4), models.OverlapReranker()).keys() == {"profile", "embedder", "reranker"}


def test_payloads_and_acknowledgements(spark):
    rows = [("a", "ready", None, [("u", None), ("v", None)]), ("b", "failed", None, None)]
    df = spark.createDataFrame(rows, "id string, index_status string, observed_at timestamp, sources array<struct<uri string, observed_at timestamp>>")
    got = {r.id: json.loads(r.body) for r in shape.payload(df, ["index_status", "sources"]).collect()}
    assert got == {"a": {"sources": [{"uri": "u"}, {"uri": "v"}]}, "b": {"index_status": "failed"}}
    done = spark.createDataFrame([("c", "m", "created"), ("d", None, "conflict")], "command_id string, memory_id string, outcome string")
    assert {tuple(r) for r in shape.acknowledgement(done).collect()} == {("c", "created", '{"memory_id":"m"}'), ("d", "conflict", "{}")}


def test_readiness_and_lanes(spark):
    from palimpsest.operators import snapshot
    from palimpsest.session import lane, lane_pools

    embedder = models.HashingEmbedder(4)
    texts = spark.createDataFrame([("s", "word")], "segment_id string, text string")
    v = models.embed(texts, "segment_id", "text", embedder)
    assert snapshot.readiness({"t": texts}, v, embedder) == {"t": True, "vectors": True, "profile": True}
    assert snapshot.readiness({"t": texts}, None, embedder) == {"t": True, "vectors": False, "profile": False}
    with lane(spark, "query"):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "query"
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None and lane_pools().count("<weight>") == 3
    with pytest.raises(ValueError), lane(spark, "other"):
        pass


def test_replace_and_upsert(spark):
    from palimpsest.operators import mutate

    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "k string, n int")
    f = spark.createDataFrame([("a", 9), ("c", 9)], "k string, n int")
    bag = lambda df: sorted(((r.k or "", r.n) for r in df.collect()))
    assert bag(mutate.replace(t, f, "k")) == [("", 1), ("a", 9), ("b", 1), ("c", 9)]
    assert bag(mutate.upsert(t, f, ["k"], parents=t)) == [("", 1), ("a", 9), ("b", 1)] and bag(mutate.upsert(t, f.limit(0), ["k"])) == bag(t)


def test_rerank_scores(spark):
    df = spark.createDataFrame([("a", "red blue"), ("b", None), ("c", "red")], "memory_id string, document string")
    got = {r.memory_id: r.reranker for r in models.rerank_scores(df, "red blue", models.OverlapReranker()).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.5}


LATE = "\n".join(["Title: T", *[f"$/parts/{i}: " + "nothing of note here. " * 40 for i in range(20)], "$/last/rule: the retention plan", "$/last/by: staff"])


def test_late_match_reaches_the_reranker(spark):
    r = records.revisions(spark, TINY).limit(1).withColumns({"id": F.lit("late"), "memory_id": F.lit("m"), "searchable_text": F.lit(LATE)})
    assert LATE.index("retention") > shape.RERANK_DOCUMENT
    (hit,) = search.matched_segments(r, r.select("id"), "retention plan").collect()
    assert "retention plan" in hit.matched and len(hit.matched) < len(LATE)
    (row,) = search.rerank_scores(r, r.select("id"), "retention plan", models.OverlapReranker()).collect()
    assert (row.memory_id, row.reranker) == ("m", 1.0)
    (none,) = search.rerank_scores(r.withColumn("searchable_text", F.lit("x")), r.select("id"), "retention plan", models.OverlapReranker()).collect()
    assert none.reranker == 0.0


def test_an_index_gives_the_same_evidence(spark):
    from palimpsest.operators import lexical, postings

    r = records.revisions(spark, TINY)
    hits = lexical.top(lexical.bm25(search.corpus(r), search.WEIGHTS, records.QUERY), 12, "id").select("id")
    for units, show in ((search.segment_units, search.matched_segments), (search.line_units, search.matched_lines)):
        index = postings.build(units(r), ["text"], "unit")
        want = {tuple(x) for x in show(r, hits, records.QUERY).collect()}
        assert {tuple(x) for x in show(r, hits, records.QUERY, index=index).collect()} == want and want


def test_excerpt_is_round_the_matched_line(spark):
    long = "$/a: " + "word " * 900 + "retention " + "word " * 900
    texts = {"late": LATE, "long": f"{long}\n$/b: x", "more": "Title: T\n$/a: one\ntwo retention\n$/b: x", "head": "Title: retention\n$/a: x\n$/b: y", "none": "Title: T\n$/a: x"}
    r = spark.createDataFrame(list(texts.items()), "id string, searchable_text string")
    got = {x.id: (x.path, x.excerpt) for x in search.excerpts(r, r.select("id"), "retention").collect()}
    assert got["late"] == ("$/last/rule", "Title: T\n$/last/rule: the retention plan\n$/last/by: staff")
    assert {k: v[0] for k, v in got.items()} == {"late": "$/last/rule", "long": "$/a", "more": "$/a", "head": "", "none": ""}
    assert all("retention" in got[k][1] for k in texts if k != "none") and all(len(x) <= shape.EXCERPT for _, x in got.values())
    assert got["none"][1] == texts["none"]
