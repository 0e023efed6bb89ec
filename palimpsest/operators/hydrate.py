"""Whole records: a revision with its state, tags, sources, feedback and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.operators import feedback as fb, graph, temporal
from palimpsest.operators.filters import normalise_tags


def children(revisions: DataFrame) -> DataFrame:
    """(id, tags, sources): tags normalised and in order, sources as stored, empty for null."""
    none = F.from_json(F.lit("[]"), revisions.schema["sources"].dataType)
    return revisions.select("id", F.coalesce(normalise_tags("tags"), F.array().cast("array<string>")).alias("tags"), F.coalesce("sources", none).alias("sources"))


def records(revisions: DataFrame, events: DataFrame, feedback: DataFrame, redirects: DataFrame, at: str | None = None) -> DataFrame:
    """``revisions`` with state, feedback counts and status, canonical memory and merged count.

    One join per relation, whatever the number of records. A revision whose memory has no state yet
    at the instant leaves. Feedback and redirects are those seen by then.
    """
    state = temporal.states_as_of(events, at).select("memory_id", "state")
    summary = fb.summary(feedback, at).select(F.col("revision_id").alias("id"), "content_count", "retrieval_count", F.col("status").alias("feedback_status"))
    moved = graph.latest_redirects(redirects, at).select(F.col("source_memory_id").alias("memory_id"), "canonical_memory_id")
    merged = graph.merged_counts(redirects, at)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    child = children(revisions).withColumnsRenamed({"tags": "_tags", "sources": "_sources"})
    whole = revisions.drop("tags", "sources").join(child, "id") if "sources" in revisions.columns else revisions
    joined = whole.join(state, "memory_id").join(summary, "id", "left").join(moved, "memory_id", "left").join(merged, "memory_id", "left")
    kept = [c for c in revisions.columns if c not in ("tags", "sources")]
    return joined.select(
        *kept, F.col("_tags").alias("tags"), F.col("_sources").alias("sources"), "state", zero("content_count"), zero("retrieval_count"),
        F.coalesce("feedback_status", F.lit("unreviewed")).alias("feedback_status"), F.coalesce("canonical_memory_id", "memory_id").alias("canonical_id"), zero("merged_count"),
    )


def point_read(revisions: DataFrame, events: DataFrame, memory: str, revision: str | None = None, at: str | None = None) -> DataFrame:
    """The one revision of a memory that is asked for: the named one, else that of ``at``, else the
    current one, with the state of ``at`` or the current state. Raises where there is none."""
    own = revisions.filter(F.col("memory_id") == memory).dropDuplicates(["id"])
    chosen = own.filter(F.col("id") == revision) if revision is not None else temporal.revisions_as_of(own, at)
    state = temporal.states_as_of(events.filter(F.col("memory_id") == memory), at).select("memory_id", "state")
    if chosen.isEmpty():
        raise LookupError(f"{memory} has no such revision")
    if state.isEmpty():
        raise LookupError(f"{memory} has no state then")
    return chosen.join(F.broadcast(state), "memory_id")  # one row
