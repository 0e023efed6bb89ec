"""Links, merge redirects and bounded traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators.temporal import instant, latest, live_at
from palimpsest.session import materialize

# The relation of redirects, and the edge budget of a level.
MERGED = "merged-into"
LEAST_EDGES, MOST_EDGES = 100, 20_000


def latest_redirects(redirects: DataFrame, at: str | None = None) -> DataFrame:
    """Each source's latest redirect by ``at``, by (created_at, id)."""
    seen = redirects if at is None else redirects.filter(F.col("created_at") <= instant(at))
    return latest(seen, ["source_memory_id"], [F.desc("created_at"), F.desc("id")])


def redirect_links(redirects: DataFrame, at: str) -> DataFrame:
    """Redirects as links of their own relation."""
    return latest_redirects(redirects, at).select(
        F.col("id").alias("link_id"), F.col("source_memory_id").alias("src"), F.col("canonical_memory_id").alias("dst"), F.lit(MERGED).alias("relation"), "created_at"
    )


def live_links(links: DataFrame, at: str) -> DataFrame:
    return links.filter(live_at(at)).select("link_id", "src", "dst", "relation", "created_at")


def resolve_canonical(redirects: DataFrame, at: str | None = None, most_rounds: int = 64) -> DataFrame:
    """(memory_id, canonical_id, hops) of every redirected memory: redirects followed to their end.

    Paths double every round, so chains of n take log2(n) joins. A path longer than there are
    redirects is a cycle, which raises.
    """
    step = latest_redirects(redirects, at).select(F.col("source_memory_id").alias("memory_id"), F.col("canonical_memory_id").alias("canonical_id"), F.lit(1).cast("bigint").alias("hops"))
    now = materialize(step, "canonical")
    longest = now.count()
    for _ in range(most_rounds):
        further = now.select(F.col("memory_id").alias("canonical_id"), F.col("canonical_id").alias("next"), F.col("hops").alias("more"))
        after = materialize(
            now.join(further, "canonical_id", "left").select(
                "memory_id", F.coalesce("next", "canonical_id").alias("canonical_id"), (F.col("hops") + F.coalesce("more", F.lit(0).cast("bigint"))).alias("hops"), F.col("next").isNotNull().alias("moved")
            ),
            "canonical",
        )
        if after.filter((F.col("hops") > longest) | (F.col("memory_id") == F.col("canonical_id"))).limit(1).count():
            raise ValueError("redirects form a cycle")
        if not after.filter("moved").limit(1).count():
            return after.select("memory_id", "canonical_id", F.col("hops").cast("int").alias("hops"))
        now = after.drop("moved")
    raise ValueError("redirects form a cycle")


def merged_counts(redirects: DataFrame, at: str | None = None) -> DataFrame:
    return latest_redirects(redirects, at).groupBy(F.col("canonical_memory_id").alias("memory_id")).agg(F.count(F.lit(1)).alias("merged_count"))


def directed(links: DataFrame, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """Edges (a, b, link_id, relation, created_at, outgoing) as seen from a."""
    from palimpsest.operators.filters import nocase

    if relations:
        links = links.filter(nocase("relation").isin([r.lower() for r in relations]))
    columns = ["link_id", "relation", "created_at"]
    out = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), *columns, F.lit(True).alias("outgoing"))
    back = links.select(F.col("dst").alias("a"), F.col("src").alias("b"), *columns, F.lit(False).alias("outgoing"))
    if direction == "out":
        return out
    if direction == "in":
        return back
    # A link from a node to itself is one edge, not two.
    return out.unionByName(back.filter("a <> b"))


def traverse(edges: DataFrame, root: str, depth: int, most: int) -> DataFrame:
    """(memory_id, depth, place, via, outgoing, path): nodes within ``depth`` links of ``root`` in the
    order of discovery, each once, by its first discoverer; at most ``most`` nodes, the root first.

    A level looks at the budget's edges in (created_at, link_id) order; the frontier it joins is
    bounded by ``most``, so it is broadcast. Where a level has more edges, it is the last.
    """
    spark = edges.sparkSession
    # Written once, however many levels read them.
    edges = materialize(edges.select("a", "b", "link_id", "relation", "created_at", "outgoing"), "graph")
    schema = "memory_id string, depth int, place long, via string, outgoing boolean, path array<string>"
    seen = spark.createDataFrame([(root, 0, 0, None, None, [])], schema)
    total, frontier = 1, seen
    for level in range(1, depth + 1):
        left = most - total
        if left <= 0:
            break
        budget = min(max(4 * (left + 1), LEAST_EDGES), MOST_EDGES)
        parents = F.broadcast(frontier.select(F.col("memory_id").alias("a"), F.col("place").alias("parent"), F.col("path").alias("_path")))
        touched = edges.join(parents, "a").orderBy("created_at", "link_id", "a").limit(budget + 1)
        touched = materialize(touched, "edges")
        truncated = touched.count() > budget
        if truncated:
            touched = touched.orderBy("created_at", "link_id", "a").limit(budget)
        fresh = touched.join(F.broadcast(seen.select(F.col("memory_id").alias("b"))), "b", "left_anti")
        found_first = [F.asc("parent"), F.asc("created_at"), F.asc("link_id")]
        first = latest(fresh, ["b"], found_first).orderBy(*found_first).limit(left)
        # Numbering one bounded level in one task.
        numbered = first.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*found_first)) + F.lit(total - 1))
        frontier = materialize(
            numbered.select(
                F.col("b").alias("memory_id"), F.lit(level).alias("depth"), F.col("place").cast("long").alias("place"), F.col("link_id").alias("via"), "outgoing",
                F.concat("_path", F.array("link_id")).alias("path"),
            ),
            "level",
        )
        found = frontier.count()
        if not found:
            break
        total += found
        seen = seen.unionByName(frontier)
        if truncated:
            break
    return seen


def traversal_score(text: Column, query: str, depth: Column, salience: Column, confidence: Column) -> Column:
    """Relevance of a traversed node to a query, between 0 and 1."""
    import regex

    q = query.strip().lower()
    terms = sorted(set(regex.findall(r"[\p{L}\p{N}]+", q)))
    lowered = F.lower(text)
    phrase = F.when(F.contains(lowered, F.lit(q)), 1.0).otherwise(0.0)
    if terms:
        share = sum((F.when(F.contains(lowered, F.lit(t)), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / len(terms)
    else:
        share = F.lit(0.0)
    return 0.35 * phrase + 0.40 * share + 0.15 / (depth + 1) + 0.05 * F.coalesce(salience, F.lit(0.5)) + 0.05 * F.coalesce(confidence, F.lit(0.5))
