"""References to records that are missing, deleted, or younger than the reference.

A Bloom filter over the parent keys proves definite orphans without a shuffle. Every reference is
probed once and written with its answer; only those the filter lets through are joined exactly, keys
with very many references by a broadcast of bounded size, so that no task receives a hot key's whole
group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.functions.bloom import might_contain
from palimpsest.session import materialize

#: References per key from which a key is hot, and the most hot keys that are broadcast.
HOT_ROWS = 200_000
MAX_HOT_KEYS = 10_000

OUTPUT = ("table_name", "field", "record_id", "reason", "ref_time")


def references(df: DataFrame, table_name: str, field: str, time: str, id_column: str = "id", target: str = "") -> DataFrame:
    """Rows of ``df`` as references to ``target``: (table_name, field, record_id, target, key, ref_time).

    Null references and rows without an id are no cases.
    """
    return df.select(
        F.lit(table_name).alias("table_name"),
        F.lit(field).alias("field"),
        F.col(id_column).alias("record_id"),
        F.lit(target).alias("target"),
        F.col(field).alias("key"),
        F.col(time).alias("ref_time"),
    ).filter(F.col("key").isNotNull() & F.col("record_id").isNotNull())


def parents(df: DataFrame, created: str, deleted_from=None, id_column: str = "id", target: str = "") -> DataFrame:
    """Targets as (target, key, created, deleted_from), one row per key.

    ``deleted_from`` is the first moment at which a reference meets a deleted target, or null.
    Redelivered targets count once.
    """
    gone = deleted_from if deleted_from is not None else F.lit(None).cast("timestamp")
    return (
        df.filter(F.col(id_column).isNotNull())
        .select(F.lit(target).alias("target"), F.col(id_column).alias("key"), F.col(created).alias("created"), gone.alias("deleted_from"))
        .groupBy("target", "key")
        .agg(F.min("created").alias("created"), F.min("deleted_from").alias("deleted_from"))
    )


def _reason(found) -> F.Column:
    return (
        F.when(found.isNull(), "missing")
        .when(F.col("deleted_from") <= F.col("ref_time"), "deleted")
        .when(F.col("created") > F.col("ref_time"), "late")
    )


def find_orphans(refs: DataFrame, targets: DataFrame, expected_keys: int, hot_rows: int = HOT_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """Broken references among ``refs`` (of :func:`references`) to ``targets`` (of :func:`parents`).

    Gives (table_name, field, record_id, reason, ref_time), one row per broken reference. A
    reference without time can only be ``missing``; redelivered references count once; without
    targets every reference is missing. ``keys`` (target, key) are those of the targets, repeats
    allowed, for a filter that needs no shuffle; ``expected_keys`` sets its size.
    """
    keys = targets.select("target", "key") if keys is None else keys
    join = ["target", "key"]
    named = lambda df: df.withColumn("_k", F.struct("target", "key"))
    passes = might_contain(named(keys.filter(F.col("key").isNotNull())), "_k", "_k", expected_keys)
    probed = materialize(named(refs).withColumn("passes", passes).drop("_k"), "probed")
    definite = probed.filter(~F.col("passes")).withColumn("reason", F.lit("missing"))
    possible = probed.filter("passes")

    hot = (
        possible.groupBy(*join)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= hot_rows)
        .orderBy(F.desc("n"), *join)
        .limit(MAX_HOT_KEYS)
        .select(*join)
    )
    hot = materialize(hot, "hot")
    known = targets.withColumn("found", F.lit(True))
    cold = possible.join(F.broadcast(hot), join, "left_anti").join(known, join, "left")
    verified = cold.withColumn("reason", _reason(F.col("found"))).select(*OUTPUT)
    if not hot.isEmpty():
        near = possible.join(F.broadcast(hot.join(known, join, "left")), join)
        verified = verified.unionByName(near.withColumn("reason", _reason(F.col("found"))).select(*OUTPUT))
    broken = definite.select(*OUTPUT).unionByName(verified.filter(F.col("reason").isNotNull()))
    return broken.dropDuplicates(["table_name", "field", "record_id"])


def per_month(orphans: DataFrame) -> DataFrame:
    """Counts of broken references per table, field, month of the reference, and reason."""
    return (
        orphans.groupBy("table_name", "field", F.date_format("ref_time", "yyyy-MM").alias("month"), "reason")
        .agg(F.count(F.lit(1)).alias("n_references"))
    )
