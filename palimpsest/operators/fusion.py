"""Ranked lists into one: reciprocal-rank fusion, boosts, the rerank gate and pruning.

Channels are bounded top-k lists, so everything here is small whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values of the ranking.
RRF_K = 60
EXACT_WEIGHT = 0.1
TITLE_EQUAL, TITLE_CONTAINS = 0.04, 0.02
RERANK_WEIGHT = 0.05
CLEAR_LEAD = 1.1
DECISIVE, RUNNER_UP = 0.5, 0.02
RELATION_SCORE = 0.005

#: Order in which channels are processed; earlier ones win ties, later ones give the evidence.
CHANNELS = ("exact", "lexical", "semantic")


def channel(df: DataFrame, name: str, order: list[Column], memory: str = "memory_id", evidence: str = "id") -> DataFrame:
    """(memory_id, evidence, channel, rank): rank over memories, each by its first hit."""
    at = Window.partitionBy().orderBy(*order)
    first = df.withColumn("_at", F.row_number().over(at)).withColumn("_n", F.row_number().over(Window.partitionBy(memory).orderBy("_at"))).filter("_n = 1")
    return first.select(
        F.col(memory).alias("memory_id"), F.col(evidence).alias("evidence"), F.lit(CHANNELS.index(name)).alias("channel"),
        F.row_number().over(Window.partitionBy().orderBy("_at")).alias("rank"),
    )


def fuse(*channels: DataFrame) -> DataFrame:
    """(memory_id, evidence, fused, exact_rank, lexical_rank, semantic_rank, first_channel, first_rank)."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    gain = F.when(F.col("channel") == 0, EXACT_WEIGHT / F.col("rank")).otherwise(1.0 / (RRF_K + F.col("rank")))
    ranks = {f"{name}_rank": F.min(F.when(F.col("channel") == i, F.col("rank"))) for i, name in enumerate(CHANNELS)}
    return every.groupBy("memory_id").agg(
        F.sum(gain).alias("fused"),
        F.max_by("evidence", "channel").alias("evidence"),
        *[c.alias(n) for n, c in ranks.items()],
        F.min(F.struct("channel", "rank")).alias("first_seen"),
    ).select("memory_id", "evidence", "fused", *ranks, F.col("first_seen.channel").alias("first_channel"), F.col("first_seen.rank").alias("first_rank"))


def title_boost(df: DataFrame, query: str, title: str = "title") -> DataFrame:
    lowered, q = F.lower(title), query.strip().lower()
    boost = F.when(lowered == q, TITLE_EQUAL).when(F.contains(lowered, F.lit(q)), TITLE_CONTAINS).otherwise(0.0)
    return df.withColumn("boost", F.coalesce(boost, F.lit(0.0))).withColumn("fused", F.col("fused") + F.col("boost"))


def order() -> list[Column]:
    """Best first; equal scores by the channel and rank that saw them first."""
    return [F.desc("fused"), F.asc("first_channel"), F.asc("first_rank"), F.asc("memory_id")]


def expand_relations(fused: DataFrame, edges: DataFrame, active: DataFrame, seeds: int = 10, per_seed: int = 100) -> DataFrame:
    """Active neighbours of the best ``seeds`` that are not among the results yet, at a low score.

    ``edges``: (a, b, created_at, link_id) as seen from a; ``active``: (memory_id).
    """
    top = fused.orderBy(*order()).limit(seeds).withColumn("seed", F.row_number().over(Window.partitionBy().orderBy(*order()))).select(F.col("memory_id").alias("a"), "seed")
    near = edges.join(F.broadcast(top), "a").withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("created_at", "link_id"))).filter(F.col("n") <= per_seed)
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("seed", "n"))).filter("r = 1")
    fresh = first.select(F.col("b").alias("memory_id"), "seed", "n").join(fused.select("memory_id"), "memory_id", "left_anti").join(active, "memory_id", "left_semi")
    return fresh.select("memory_id", F.lit(RELATION_SCORE).alias("fused"), F.lit(len(CHANNELS)).alias("first_channel"), (F.col("seed") * 1000 + F.col("n")).alias("first_rank"))


def needs_rerank(top_two: list, scoped: bool) -> bool:
    """Whether the automatic mode should rerank, from the two best fused rows."""
    if len(top_two) < 2 or top_two[0]["exact_rank"] is not None:
        return False
    if not scoped:
        return True
    agree = top_two[0]["lexical_rank"] == 1 and top_two[0]["semantic_rank"] == 1
    return not (agree and top_two[0]["fused"] >= top_two[1]["fused"] * CLEAR_LEAD)


def rerank(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Adds ``reranker`` scores (memory_id, reranker) into the fused ones."""
    return df.join(scores, "memory_id", "left").withColumn("fused", F.col("fused") + RERANK_WEIGHT * F.coalesce("reranker", F.lit(0.0)))


def prune_decisive(df: DataFrame) -> DataFrame:
    """Only the winner and exact hits where the winner's reranker score leaves the others far behind."""
    at = F.row_number().over(Window.partitionBy().orderBy(*order()))
    numbered = df.withColumn("place", at)
    every = Window.partitionBy()
    winner = F.max(F.when(F.col("place") == 1, F.col("reranker"))).over(every)
    other = F.coalesce(F.max(F.when(F.col("place") > 1, F.col("reranker"))).over(every), F.lit(0.0))
    decisive = F.coalesce((winner >= DECISIVE) & (other < RUNNER_UP * winner), F.lit(False))
    return numbered.withColumn("_decisive", decisive).filter(~F.col("_decisive") | (F.col("place") == 1) | F.col("exact_rank").isNotNull()).drop("_decisive")
