"""The search plan: candidates, three retrieval channels, fusion, title boost, relation expansion, the
rerank gate, reranking and pruning, top-k; what shows a hit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.operators import filters, fusion, lexical, models, postings, segments, shape, vectors
from palimpsest.session import materialize

WEIGHTS = {"title": 2.0, "searchable_text": 1.0, "tag_text": 0.5}
#: A line of a searchable text that begins a field, with the field's path.
FIELD_LINE = r"^(\$(?:/[^:]*)?|metadata/[^:]*|sources/[0-9]+/[^:]*):"
#: Matched segments in a rerank document.
EVIDENCE_SEGMENTS = 2
# Exact hits, results, and the sizes of the set that is reranked.
MOST_EXACT, MOST_RESULTS = 50, 50
LEAST_RERANKED, MOST_RERANKED = 3, 30
MODES = ("auto", "fast", "quality", "lexical", "semantic")


@dataclass(frozen=True)
class Tables:
    memories: DataFrame
    revisions: DataFrame
    events: DataFrame
    spaces: DataFrame
    vectors: DataFrame | None = None
    #: The inverted index of the revisions; without one every text is scored where it lies.
    index: postings.Index | None = None
    #: (a, b, created_at, link_id), for relation expansion.
    edges: DataFrame | None = None


def corpus(revisions: DataFrame) -> DataFrame:
    """Every revision as an index row: statistics are those of all of them."""
    return revisions.select("id", "memory_id", "recorded_at", "title", "searchable_text", F.array_join("tags", " ").alias("tag_text"))


def channels(tables: Tables, wanted: filters.Candidates, query: str, vector: list[float] | None, profile: str | None, k: int, mode: str = "auto") -> list[DataFrame]:
    eligible = filters.candidates(tables.revisions, tables.events, tables.spaces, wanted)
    heads = eligible.select("id", "memory_id", "recorded_at", "title")
    found = [fusion.channel(lexical.exact(heads, tables.memories, query, min(k, MOST_EXACT)), "exact", [F.asc("rank_value"), F.desc("recorded_at"), F.asc("id")])]
    if mode != "semantic":
        if tables.index is not None:
            scored = postings.search(tables.index, list(WEIGHTS.values()), query)
        else:
            scored = lexical.bm25(corpus(tables.revisions.dropDuplicates(["id"])), WEIGHTS, query).select("id", "score")
        scored = scored.join(heads.select("id", "memory_id"), "id")
        found.append(fusion.channel(lexical.top(scored, k, "id"), "lexical", [F.desc("score"), F.asc("id")]))
    if mode != "lexical" and vector is not None and tables.vectors is not None:
        segments = tables.vectors.filter(F.col("model_profile_id") == profile).select("segment_id", "embedding", F.substring_index("segment_id", ":", 1).alias("id"))
        near = vectors.nearest(segments.join(heads.select("id", "memory_id"), "id"), "embedding", vector, k, "segment_id")
        found.append(fusion.channel(near, "semantic", [F.asc("distance"), F.asc("segment_id")]))
    return found


def segment_units(revisions: DataFrame) -> DataFrame:
    """(unit, id, ordinal, text): the index segments of revisions, each by a name of its own."""
    built = segments.build(revisions, "id", "searchable_text")
    return built.select(F.col("segment_id").alias("unit"), F.col("record_id").alias("id"), "ordinal", "text")


def line_units(revisions: DataFrame) -> DataFrame:
    """(unit, id, position, part, text): the lines of revisions, those too long for an excerpt in parts."""
    lines = revisions.select("id", F.posexplode(F.split("searchable_text", "\n")).alias("position", "line"))
    whole = F.regexp_extract_all("line", F.lit(rf"(?s).{{1,{shape.EXCERPT}}}(?!\S)|.{{1,{shape.EXCERPT}}}"), F.lit(0))
    parts = lines.select("id", "position", F.posexplode(whole).alias("part", "text"))
    return parts.select(F.concat_ws(":", "id", "position", "part").alias("unit"), "id", "position", "part", "text")


def _scored(units: Callable[[DataFrame], DataFrame], revisions: DataFrame, hits: DataFrame, query: str, index: postings.Index | None) -> DataFrame:
    """The units of the few ``hits`` (id) that match, with their score by BM25 over the units of all
    revisions: from an ``index`` of those (column ``text``), or by scoring every one."""
    if index is None:
        return lexical.bm25(units(revisions), {"text": 1.0}, query).join(F.broadcast(hits.select("id")), "id", "left_semi")
    few = revisions.join(F.broadcast(hits.select("id")), "id", "left_semi")
    return units(few).join(postings.search(index, [1.0], query).withColumnRenamed("id", "unit"), "unit")


def matched_segments(revisions: DataFrame, hits: DataFrame, query: str, most: int = EVIDENCE_SEGMENTS, index: postings.Index | None = None) -> DataFrame:
    """(id, matched): the best ``most`` index segments of each of the few ``hits`` (id), best first. A
    hit without a matching segment has no row."""
    scored = _scored(segment_units, revisions, hits, query, index)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "ordinal"))
    best = scored.withColumn("n", place).filter(F.col("n") <= most)
    ordered = F.sort_array(F.collect_list(F.struct("n", "text")))
    return best.groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("matched"))


def matched_lines(revisions: DataFrame, hits: DataFrame, query: str, index: postings.Index | None = None) -> DataFrame:
    """(id, path, at, matched): the best line of each of the few ``hits`` (id). ``path`` is that of the
    field it lies in, empty for head lines; ``at`` is null where the line does not begin the field. Of a
    line too long for an excerpt ``matched`` is the best part."""
    scored = _scored(line_units, revisions, hits, query, index)
    few = revisions.join(F.broadcast(hits.select("id")), "id", "left_semi").select("id", F.split("searchable_text", "\n").alias("_lines"))
    path = lambda line: F.regexp_extract(line, FIELD_LINE, 1)
    before = F.filter(F.transform(F.slice("_lines", 1, F.col("position") + 1), path), lambda p: p != "")
    placed = scored.join(few, "id").withColumns({"path": F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("")), "line": F.element_at("_lines", F.col("position") + 1)})
    begins = (F.col("path") != "") & (path(F.col("line")) == F.col("path")) & (F.length("line") <= shape.EXCERPT)
    placed = placed.withColumn("at", F.when(begins, F.col("path")))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("path") == "", F.desc("score"), "position", "part"))
    return placed.withColumn("n", place).filter("n = 1").select("id", "path", "at", F.col("text").alias("matched"))


def excerpts(revisions: DataFrame, hits: DataFrame, query: str, index: postings.Index | None = None) -> DataFrame:
    """(id, path, excerpt) of the few ``hits`` (id): what surrounds the best line."""
    texts = revisions.join(F.broadcast(hits.select("id")), "id", "left_semi").select("id", "searchable_text")
    found = texts.join(matched_lines(revisions, hits, query, index), "id", "left")
    shown = found.withColumns({"path": F.coalesce("path", F.lit("")), "at": F.coalesce("at", F.lit("")), "matched": F.coalesce("matched", "searchable_text")})
    return shape.with_excerpt(shown, "id", "searchable_text", "at", "matched").select("id", "path", "excerpt")


def rerank_scores(revisions: DataFrame, hits: DataFrame, query: str, reranker, index: postings.Index | None = None) -> DataFrame:
    """(memory_id, reranker) of the few ``hits`` (id), from what matched in them."""
    rows = revisions.join(F.broadcast(hits.select("id")), "id", "left_semi").join(matched_segments(revisions, hits, query, index=index), "id", "left")
    documents = rows.withColumn("document", shape.rerank_document(F.coalesce("matched", "searchable_text")))
    return models.rerank_scores(documents, query, reranker)


def search(
    tables: Tables, wanted: filters.Candidates, query: str, vector: list[float] | None = None, profile: str | None = None, k: int = 5, depth: int = 100, mode: str = "auto",
    scorer: Callable[[DataFrame, str], DataFrame] | None = None, expand: bool = False,
) -> DataFrame:
    """(place, memory_id, evidence, fused, ranks, boost, reranker, title, degraded): the k best memories.

    ``quality`` reranks, ``auto`` does where the best two leave doubt (:func:`fusion.needs_rerank`), the
    other modes never do; ``scorer`` gives (memory_id, reranker) for the few hits (id, memory_id, title)
    and the query. What a mode asks for and cannot have, vectors or a scorer, is left out and named in
    ``degraded``. With ``expand`` linked memories that were not found follow at a low score.
    """
    if not query.strip():
        raise ValueError("a blank query")
    if mode not in MODES:
        raise ValueError(f"a mode is one of {MODES}")
    k = min(max(k, 1), MOST_RESULTS)
    degraded = []
    if mode != "lexical" and (vector is None or tables.vectors is None):
        degraded.append("no vectors")
    # From here on there are as many rows as the channels give, a few hundred at most.
    fused = fusion.fuse(*channels(tables, wanted, query, vector, profile, depth, mode))
    if expand and tables.edges is not None:
        active = filters.candidates(tables.revisions, tables.events, tables.spaces, wanted).select("memory_id", "id")
        near = fusion.expand_relations(fused, tables.edges, active.select("memory_id")).join(active.withColumnRenamed("id", "evidence"), "memory_id")
        fused = fused.unionByName(near, allowMissingColumns=True)
    titles = tables.revisions.select(F.col("id").alias("evidence"), "title")
    titled = titles.join(F.broadcast(fused.select("evidence").distinct()), "evidence", "left_semi").dropDuplicates(["evidence"])
    ordered = materialize(fusion.title_boost(fused.join(titled, "evidence", "left"), query), "fused")
    first = ordered.orderBy(*fusion.order()).limit(2).collect()
    wants = mode == "quality" and len(first) > 1 or mode == "auto" and fusion.needs_rerank(first, wanted.spaces is not None)
    if wants and scorer is None:
        degraded.append("no reranker")
    elif wants:
        best = ordered.orderBy(*fusion.order()).limit(min(MOST_RERANKED, max(LEAST_RERANKED, 2 * k)))
        scores = scorer(best.select(F.col("evidence").alias("id"), "memory_id", "title"), query)
        ordered = fusion.prune_decisive(fusion.rerank(ordered, scores)).drop("place")
    if "reranker" not in ordered.columns:
        ordered = ordered.withColumn("reranker", F.lit(None).cast("double"))
    top = ordered.orderBy(*fusion.order()).limit(k)
    place = F.row_number().over(Window.partitionBy().orderBy(*fusion.order()))
    return top.select(
        place.alias("place"), "memory_id", "evidence", "fused", "exact_rank", "lexical_rank", "semantic_rank", "boost", "reranker", "title", F.lit("; ".join(degraded)).alias("degraded")
    )


def model_scorer(revisions: DataFrame, reranker, index: postings.Index | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A scorer that gives a model the documents of :func:`rerank_scores`."""
    return lambda hits, query: rerank_scores(revisions.dropDuplicates(["id"]), hits, query, reranker, index)
