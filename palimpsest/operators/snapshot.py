"""Nested export, status counts, backup and compaction of table folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Revisions or events of a memory in one exported row.
PART = 1000


def export_nested(memories: DataFrame, revisions: DataFrame, events: DataFrame, part: int = PART) -> DataFrame:
    """Memories with their revisions and state events as ordered arrays: (memory_id, part, space_id,
    logical_key, revisions, events).

    Part n holds the numbers from n * ``part``, so that a memory with a long history spreads over
    rows of bounded size; a memory without history has one row with a null part.
    """
    place = lambda number: F.floor(F.col(number) / part).alias("part")
    history = revisions.groupBy("memory_id", place("revision_number")).agg(
        F.sort_array(F.collect_list(F.struct("revision_number", F.col("id").alias("revision_id"), "title", "kind"))).alias("revisions")
    )
    states = events.groupBy("memory_id", place("event_number")).agg(F.sort_array(F.collect_list(F.struct("event_number", "state"))).alias("events"))
    head = memories.select(F.col("id").alias("memory_id"), "space_id", "logical_key")
    return head.join(history.join(states, ["memory_id", "part"], "full_outer"), "memory_id", "left")


def status(memories: DataFrame) -> DataFrame:
    """Counts by state and index status, zero where there are none."""
    count = lambda c, v: F.coalesce(F.sum((F.col(c) == v).cast("bigint")), F.lit(0)).alias(f"{v.replace('-', '_')}")
    return memories.groupBy("space_id").agg(
        F.count(F.lit(1)).alias("total"), *[count("state", s) for s in ("active", "archived", "deleted")],
        *[count("index_status", s) for s in ("pending", "ready", "lexical-only", "failed")], F.count("logical_key").alias("logical_keys"),
    )


def scoped_counts(memories: DataFrame, revisions: DataFrame, events: DataFrame, feedback: DataFrame, redirects: DataFrame, scope: DataFrame) -> DataFrame:
    """One row of counts over the memories whose space is in ``scope`` (space_id)."""
    own = memories.join(scope.distinct(), "space_id", "left_semi")
    ids = own.select(F.col("id").alias("memory_id"))
    inside = lambda df, key="memory_id": df.join(ids.withColumnRenamed("memory_id", key), key, "left_semi")
    count = lambda df, what=F.count(F.lit(1)): df.agg(what.alias("n")).scalar()
    moved = inside(redirects, "source_memory_id")
    return own.agg(F.count(F.lit(1)).alias("memories"), F.count("logical_key").alias("logical_keys"), F.count_if(F.col("index_status") == "pending").alias("pending_jobs")).select(
        "memories", count(inside(revisions)).alias("revisions"), count(inside(events)).alias("state_events"), count(inside(feedback)).alias("feedback"),
        count(moved).alias("redirects"), count(moved, F.count_distinct("operation_id")).alias("merges"), "logical_keys", "pending_jobs",
    )


def readiness(tables: dict[str, DataFrame], vectors: DataFrame | None, embedder=None) -> dict[str, bool]:
    """Whether each table can be read, whether there is a current generation of vectors, and whether
    it is the embedder's."""
    ready = {}
    for name, df in tables.items():
        try:
            df.limit(1).count()
            ready[name] = True
        except Exception:  # noqa: BLE001 - a table that cannot be read is not ready
            ready[name] = False
    first = vectors.select("model_profile_id").first() if vectors is not None else None
    ready["vectors"] = first is not None
    if embedder is not None:
        ready["profile"] = first is not None and first["model_profile_id"] == embedder.profile.id
    return ready


def export_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, body): every row as JSON, ordered by kind and id by a range sort."""
    lines = None
    for kind, df in tables.items():
        one = df.select(F.lit(kind).alias("kind"), "id", F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("body"))
        lines = one if lines is None else lines.unionByName(one)
    return lines.orderBy("kind", "id")


def _fs(spark: SparkSession, path: str):
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), fs_path


def backup(spark: SparkSession, tables: dict[str, DataFrame], target: str) -> str:
    """All tables written beside the target and put in place by one rename; returns the path. An
    existing target is refused before anything is written; a failed backup leaves nothing behind."""
    fs, path = _fs(spark, target)
    if fs.exists(path(target)):
        raise FileExistsError(target)
    staged = f"{target}.staging-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{staged}/{name}.parquet")
        if fs.exists(path(target)) or not fs.rename(path(staged), path(target)):
            raise OSError(f"cannot rename {staged}")
    finally:
        fs.delete(path(staged), True)
    return target


def restore(spark: SparkSession, source: str, target: str) -> str | None:
    """Puts the tables of a backup in place of those in ``target``; returns where the old ones are
    kept, or None. They are read once as a check, copied beside the target and renamed into place;
    if the last rename fails the old tables come back."""
    fs, path = _fs(spark, target)
    from_fs, _ = _fs(spark, source)
    names = sorted(f.getPath().getName() for f in from_fs.listStatus(path(source)) if f.getPath().getName().endswith(".parquet"))
    if not names:
        raise FileNotFoundError(source)
    staged, kept = f"{target}.staging-{uuid.uuid4().hex}", f"{target}.before-{uuid.uuid4().hex}"
    try:
        for name in names:
            spark.read.parquet(f"{source}/{name}").write.parquet(f"{staged}/{name}")
        had = fs.exists(path(target))
        if had and not fs.rename(path(target), path(kept)):
            raise OSError(f"cannot move {target}")
        if not fs.rename(path(staged), path(target)):
            if had:
                fs.rename(path(kept), path(target))
            raise OSError(f"cannot rename {staged}")
    finally:
        fs.delete(path(staged), True)
    return kept if had else None


def compact(df: DataFrame, target: str, files: int) -> None:
    """The table in fewer files, without a shuffle."""
    df.coalesce(files).write.parquet(target)
