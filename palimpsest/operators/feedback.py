"""Feedback summaries and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators.temporal import instant

#: Signals that count, by scope (fixed values of the data model).
CONTENT = ("correct", "incorrect", "stale", "contradicted", "verified")
RETRIEVAL = ("relevant", "irrelevant", "helpful", "not_helpful")


def standard() -> Column:
    return ((F.col("scope") == "content") & F.col("signal").isin(*CONTENT)) | ((F.col("scope") == "retrieval") & F.col("signal").isin(*RETRIEVAL))


def status(signal: str | Column) -> Column:
    s = F.col(signal) if isinstance(signal, str) else signal
    return F.when(s.isNull(), "unreviewed").when(s == "verified", "verified").when(s == "correct", "supported").otherwise("needs-review")


def summary(feedback: DataFrame, at: str | None = None) -> DataFrame:
    """(revision_id, content_count, retrieval_count, latest_content, latest_retrieval, status)."""
    seen = feedback.filter(standard()) if at is None else feedback.filter(standard() & (F.col("created_at") <= instant(at)))
    rank = F.row_number().over(Window.partitionBy("revision_id", "scope").orderBy(F.desc("created_at"), F.desc("id")))
    counts = seen.groupBy("revision_id", "scope").agg(F.count(F.lit(1)).alias("n"))
    newest = seen.withColumn("r", rank).filter("r = 1").select("revision_id", "scope", "signal")
    both = counts.join(newest, ["revision_id", "scope"])
    pick = lambda scope, column: F.max(F.when(F.col("scope") == scope, F.col(column)))
    return both.groupBy("revision_id").agg(
        F.coalesce(pick("content", "n"), F.lit(0)).alias("content_count"), F.coalesce(pick("retrieval", "n"), F.lit(0)).alias("retrieval_count"),
        pick("content", "signal").alias("latest_content"), pick("retrieval", "signal").alias("latest_retrieval"),
    ).withColumn("status", status("latest_content"))


def listed(feedback: DataFrame, memory: str | None = None, revision: str | None = None, scope: str | None = None, at: str | None = None) -> DataFrame:
    """Feedback of a memory, a revision or a scope, as far as asked for, seen by ``at``."""
    keep = F.lit(True)
    for column, value in (("memory_id", memory), ("revision_id", revision), ("scope", scope)):
        if value is not None:
            keep = keep & (F.col(column) == value)
    return feedback.filter(keep if at is None else keep & (F.col("created_at") <= instant(at)))


def with_status(df: DataFrame, feedback: DataFrame, wanted: str, revision: str = "id") -> DataFrame:
    """Rows whose revision has the wanted status; one without content feedback is unreviewed."""
    known = summary(feedback).select(F.col("revision_id").alias(revision), F.col("status").alias("_status"))
    return df.join(known, revision, "left").filter(F.coalesce("_status", F.lit("unreviewed")) == wanted).drop("_status")
