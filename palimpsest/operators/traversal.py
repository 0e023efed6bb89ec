"""Traversal as a service: all edges of a graph at an instant, ranked results, pages that stay stable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.operators import graph, paging

# Pages, ranked results, reranked results and the blend of both scores.
PAGE, MOST_PAGE = 50, 200
MOST_RANKED, MOST_OFFSET = 500, 10_000
RERANKED = 30
LEXICAL_SHARE, RERANK_SHARE = 0.4, 0.6
LINKS_OF_A_NODE = 100


def edges(links: DataFrame, redirects: DataFrame, operations: DataFrame, at: str) -> DataFrame:
    """(link_id, src, dst, relation, created_at, metadata): live links and, as links of their own
    relation, each memory's latest redirect with its merge operation (id, actor_id, reason)."""
    live = graph.live_links(links, at).withColumn("metadata", F.lit(None).cast("string"))
    why = operations.select(F.col("id").alias("operation_id"), "actor_id", "reason").dropDuplicates(["operation_id"])
    moved = graph.latest_redirects(redirects, at).join(why, "operation_id", "left")
    body = F.to_json(F.struct(F.col("operation_id").alias("operationId"), F.col("actor_id").alias("actorId"), "reason", "direct"))
    merged = moved.select(
        F.col("id").alias("link_id"), F.col("source_memory_id").alias("src"), F.col("canonical_memory_id").alias("dst"), F.lit(graph.MERGED).alias("relation"), "created_at", body.alias("metadata")
    )
    return live.unionByName(merged)


def links_of(all_edges: DataFrame, memory: str, most: int = LINKS_OF_A_NODE) -> DataFrame:
    """The first ``most`` edges that touch a memory, by (created_at, link_id)."""
    return all_edges.filter((F.col("src") == memory) | (F.col("dst") == memory)).orderBy("created_at", "link_id").limit(most)


def ranked(walked: DataFrame, heads: DataFrame, query: str, reranked: DataFrame | None = None, most_reranked: int = RERANKED) -> DataFrame:
    """``walked`` (of :func:`palimpsest.operators.graph.traverse`, so bounded) with ``relevance`` and
    ``place``: the root first, then by relevance, depth and id.

    ``heads``: (memory_id, searchable_text, salience, confidence); a node without text has the
    relevance of its depth. ``reranked``: (memory_id, reranker) for any nodes; the best
    ``most_reranked`` by relevance blend it in.
    """
    few = walked.orderBy("place").limit(MOST_RANKED)
    known = heads.select("memory_id", "searchable_text", "salience", "confidence").join(F.broadcast(few.select("memory_id")), "memory_id", "left_semi")
    scored = few.join(known, "memory_id", "left").withColumn(
        "relevance", graph.traversal_score(F.coalesce("searchable_text", F.lit("")), query, F.col("depth"), F.col("salience"), F.col("confidence"))
    )
    best = [F.desc("relevance"), F.asc("depth"), F.asc("memory_id")]
    # At most MOST_RANKED rows from here on.
    if reranked is not None:
        place = F.row_number().over(Window.partitionBy(F.col("depth") > 0).orderBy(*best))
        scored = scored.withColumn("_n", place).join(reranked.select("memory_id", "reranker"), "memory_id", "left")
        blend = (F.col("depth") > 0) & (F.col("_n") <= most_reranked) & F.col("reranker").isNotNull()
        scored = scored.withColumn("relevance", F.when(blend, LEXICAL_SHARE * F.col("relevance") + RERANK_SHARE * F.col("reranker")).otherwise(F.col("relevance"))).drop("_n")
    final = Window.partitionBy().orderBy(F.asc(F.col("depth") > 0), *best)
    return scored.withColumn("place", F.row_number().over(final) - 1).withColumn("relevance", F.round("relevance", 6)).drop("searchable_text", "salience", "confidence")


def page(rows: DataFrame, filters: dict, at: str, size: int = PAGE, cursor: str | None = None) -> tuple[DataFrame, str, str]:
    """(rows of the page, cursor of the next one, instant): rows in order of ``place``.

    A cursor holds the offset and the instant of the first page, so that later pages see the same
    graph; it belongs to its filters. Offsets end at MOST_OFFSET.
    """
    size = min(max(size, 1), MOST_PAGE)
    offset, seen_at = paging.decode(cursor, filters) if cursor else (0, at)
    if cursor and at is not None and at != seen_at:
        raise ValueError("the instant may not change between pages")
    if not isinstance(offset, int) or not 0 <= offset <= MOST_OFFSET:
        raise ValueError("not a cursor")
    own = rows.filter((F.col("place") >= offset) & (F.col("place") < min(offset + size, MOST_OFFSET)))
    return own, paging.encode([offset + size, seen_at], filters), seen_at
