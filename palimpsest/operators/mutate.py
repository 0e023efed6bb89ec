"""Mutations as batches: a set of commands becomes rows to append and rows rejected with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators.filters import nocase
from palimpsest.operators.graph import latest_redirects
from palimpsest.operators.temporal import latest


def append_once(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows whose key is not there yet, the first of each key; rows with a null in the key
    are always new."""
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    fresh = latest(incoming.filter(keyed).join(existing.select(*keys).distinct(), keys, "left_anti"), keys, order)
    return fresh.unionByName(incoming.filter(~keyed))


def compare_and_append(heads: DataFrame, commands: DataFrame) -> DataFrame:
    """Revisions proposed against an expected head: ``commands`` (command_id, arrival, memory_id,
    expected_revision_id) with ``outcome``: the first per memory whose expectation holds is
    ``applied`` with the next revision number, others are ``stale`` or ``unknown``."""
    known = commands.join(heads.select("memory_id", F.col("id").alias("head_id"), F.col("revision_number").alias("head_number")), "memory_id", "left")
    holds = F.col("head_id") == F.col("expected_revision_id")
    place = F.row_number().over(Window.partitionBy("memory_id", holds).orderBy("arrival", "command_id"))
    outcome = F.when(F.col("head_id").isNull(), "unknown").when(holds & (F.col("place") == 1), "applied").otherwise("stale")
    return known.withColumn("place", place).withColumn("outcome", outcome).select(
        "command_id", "memory_id", "outcome", F.when(F.col("outcome") == "applied", F.col("head_number") + 1).alias("revision_number")
    )


def transitions(states: DataFrame, commands: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """State commands (memory_id, state, at) as events to append: (memory_id, event_number, state,
    recorded_at). No change is no event, deleted stays deleted, a merged memory is not activated
    again; times rise by at least a millisecond over the last event."""
    now = states.select("memory_id", F.col("state").alias("old"), F.col("event_number").alias("last_number"), F.col("recorded_at").alias("last_at"))
    first = latest(commands, ["memory_id"], [F.asc("at"), F.asc("state")])
    joined = first.join(now, "memory_id", "left").filter(~F.col("state").eqNullSafe(F.col("old")) & ~F.col("old").eqNullSafe(F.lit("deleted")))
    if redirects is not None:
        merged = redirects.select(F.col("source_memory_id").alias("memory_id")).distinct()
        blocked = merged.withColumn("merged", F.lit(True))
        joined = joined.join(blocked, "memory_id", "left").filter(~(F.coalesce("merged", F.lit(False)) & (F.col("state") == "active")))
    return joined.select(
        "memory_id", (F.coalesce("last_number", F.lit(0)) + 1).alias("event_number"), "state",
        F.greatest("at", F.col("last_at") + F.expr("INTERVAL 1 MILLISECOND")).alias("recorded_at"),
    )


def merge(redirects: DataFrame, merges: DataFrame) -> DataFrame:
    """Redirects to append for ``merges`` (duplicate_id, canonical_id, at): one for each duplicate,
    direct, and one for each memory that was redirected to a duplicate, so that paths stay short."""
    valid = latest(merges.filter("duplicate_id <> canonical_id"), ["duplicate_id"], [F.asc("at"), F.asc("canonical_id")])
    direct = valid.select(F.col("duplicate_id").alias("source_memory_id"), F.col("canonical_id").alias("canonical_memory_id"), F.col("at").alias("created_at"), F.lit(True).alias("direct"))
    inherited = (
        latest_redirects(redirects).select("source_memory_id", F.col("canonical_memory_id").alias("duplicate_id"))
        .join(valid, "duplicate_id")
        .filter(F.col("source_memory_id") != F.col("canonical_id"))
        .join(valid.select(F.col("duplicate_id").alias("source_memory_id")), "source_memory_id", "left_anti")
        .select("source_memory_id", F.col("canonical_id").alias("canonical_memory_id"), F.col("at").alias("created_at"), F.lit(False).alias("direct"))
    )
    return direct.unionByName(inherited)


def new_links(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links that no active link equals: ends, relation without regard to ASCII case, and null-safe
    bounds. Repeats within ``incoming`` count once."""
    key = lambda df: df.withColumn("_r", nocase("relation"))
    once = latest(key(incoming), ["src", "dst", "_r", "valid_from", "valid_to"], [F.asc("link_id")]).alias("i")
    active = key(links.filter(F.col("deleted_at").isNull())).select("src", "dst", "_r", "valid_from", "valid_to").alias("l")
    same = (
        (F.col("i.src") == F.col("l.src")) & (F.col("i.dst") == F.col("l.dst")) & (F.col("i._r") == F.col("l._r"))
        & F.col("i.valid_from").eqNullSafe(F.col("l.valid_from")) & F.col("i.valid_to").eqNullSafe(F.col("l.valid_to"))
    )
    return once.join(active, same, "left_anti").drop("_r")


def unlink(links: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Links with the first deletion of any tombstone (link_id, at); repeats change nothing."""
    first = tombstones.groupBy("link_id").agg(F.min("at").alias("_at"))
    return links.join(first, "link_id", "left").withColumn("deleted_at", F.least("deleted_at", "_at")).drop("_at")


def replace(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the keys in ``fresh`` replaced by those of ``fresh``, e.g. the segments
    of revisions that were indexed again."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert(table: DataFrame, fresh: DataFrame, keys: list[str], parents: DataFrame | None = None) -> DataFrame:
    """The table with the rows of ``fresh`` added or, where their keys are there, in place of the old
    ones; with ``parents`` only rows whose keys those have."""
    if parents is not None:
        fresh = fresh.join(parents.select(*keys).distinct(), keys, "left_semi")
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh.dropDuplicates(keys))


def purge(table: DataFrame, gone: DataFrame, key: str = "memory_id") -> DataFrame:
    """The table without the rows of purged memories; one anti join per table."""
    return table.join(gone.select(F.col("memory_id").alias(key)).distinct(), key, "left_anti")


def reindex_queue(heads: DataFrame, open_jobs: DataFrame) -> DataFrame:
    """Current revisions that have no pending or running job."""
    busy = open_jobs.filter(F.col("status").isin("pending", "running")).select(F.col("revision_id").alias("id"))
    return heads.join(busy, "id", "left_anti")
