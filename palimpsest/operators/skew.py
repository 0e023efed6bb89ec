"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows from which a key is hot, and the most hot keys whose single row is broadcast.
HOT_ROWS = 200_000
MAX_HOT_KEYS = 10_000


def join_unique(many: DataFrame, one: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``many`` to ``one``, which has one row per key.

    Rows of hot keys stay where they are and meet their partner in a broadcast of at most
    MAX_HOT_KEYS rows; all others are joined by a shuffle. Null keys join nothing.
    """
    hot = (
        many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hot_rows)
        .orderBy(F.desc("_n"), *keys).limit(MAX_HOT_KEYS).select(*keys)
    )
    partners = one.join(F.broadcast(hot), keys, "left_semi")
    return many.join(F.broadcast(partners), keys).unionByName(many.join(F.broadcast(hot), keys, "left_anti").join(one, keys))
