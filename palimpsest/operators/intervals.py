"""Continuous periods and gaps of half-open intervals per entity.

Two levels at every size, so that a huge entity is never one task's group: intervals are clipped
into time shards of about equal row counts and merged per (entity, shard); then only one hull per
shard, and the runs of shards an interval covers whole, are stitched per entity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.columns import computed_once

UNBOUNDED_FROM = -(2**62)
UNBOUNDED_TO = 2**62

#: Rows a time shard should hold, and the fewest and most shards (the latter bounds an entity's
#: second level).
SHARD_ROWS = 100_000
MIN_SHARDS, MAX_SHARDS = 8, 4096


def normalise(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, s, e) in microseconds. Null bounds are unbounded, empty and reversed intervals and
    null entities leave; intervals that start together become one before any shuffle."""
    return (
        df.select(
            F.col(entity).alias("entity"),
            F.coalesce(F.unix_micros(F.col(start).cast("timestamp")), F.lit(UNBOUNDED_FROM)).alias("s"),
            F.coalesce(F.unix_micros(F.col(end).cast("timestamp")), F.lit(UNBOUNDED_TO)).alias("e"),
        )
        .filter(F.col("entity").isNotNull() & (F.col("s") < F.col("e")))
        .groupBy("entity", "s")
        .agg(F.max("e").alias("e"))
    )


def shard_edges(df: DataFrame, start: str, shard_rows: int, max_shards: int = MAX_SHARDS) -> list[int]:
    """Inner edges of time shards holding about ``shard_rows`` starts each, from all rows. Without
    any bounded start there is one shard."""
    micros = F.unix_micros(F.col(start).cast("timestamp"))
    # One pass: the finest quantiles there can be, of which as many are kept as the rows ask for.
    share = ", ".join(f"{i / max_shards}D" for i in range(1, max_shards))
    starts = df.select(micros.alias("t"))
    found = starts.agg(F.count("t").alias("n"), F.expr(f"percentile_approx(t, array({share}), {4 * max_shards})").alias("q")).first()
    if not found["n"]:
        return []
    shards = max(min(MIN_SHARDS, max_shards), min(max_shards, math.ceil(found["n"] / shard_rows)))
    return sorted({found["q"][i * max_shards // shards - 1] for i in range(1, shards)})


def _numbers(values: list[int]) -> Column:
    """A constant array; the optimizer folds it into one literal."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _shard(column: Column, edges: list[int], block: int = 64) -> Column:
    """Index of the shard that holds the value: the number of edges not after it, found in blocks."""
    blocks = [edges[i : i + block] for i in range(0, len(edges), block)]
    not_after = lambda e: e <= column
    if len(blocks) < 2:
        return F.size(F.filter(_numbers(edges), not_after))
    full = F.size(F.filter(_numbers([x[-1] for x in blocks[:-1]]), not_after))
    return full * block + F.size(F.filter(F.slice(_numbers(edges), full * block + 1, F.lit(block)), not_after))


def gaps_and_hulls(intervals: DataFrame, edges: list[int]) -> tuple[DataFrame, DataFrame]:
    """Gaps (entity, gap_from, gap_to, shard) and hulls (entity, low, high) of normalised intervals."""
    low, high = _numbers([UNBOUNDED_FROM, *edges]), _numbers([*edges, UNBOUNDED_TO])
    placed = computed_once(intervals, {"a": _shard(F.col("s"), edges), "b": _shard(F.col("e") - 1, edges)})
    part = lambda shard, s, e, run: F.struct(shard.alias("shard"), s.alias("s"), e.alias("e"), run.alias("run"))
    a, b, none = F.col("a"), F.col("b"), F.lit(-1)
    first, last = part(a, F.col("s"), high[a], none), part(b, low[b], F.col("e"), none)
    # An interval that covers shards whole is one run of them, kept in the first.
    pieces = placed.select(
        "entity",
        F.inline(
            F.when(a == b, F.array(part(a, F.col("s"), F.col("e"), none)))
            .when(b - a == 1, F.array(first, last))
            .otherwise(F.array(first, last, part(a + 1, low[a + 1], high[b - 1], b - 1)))
        ),
    )
    pieces = pieces.groupBy("entity", "shard", "s").agg(F.max("e").alias("e"), F.max("run").alias("run"))
    local = Window.partitionBy("entity", "shard").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    inner = (
        pieces.withColumn("covered_to", F.max("e").over(local))
        .filter(F.col("s") > F.col("covered_to"))
        .select("entity", "shard", F.col("covered_to").alias("gap_from"), F.col("s").alias("gap_to"))
    )
    hulls = pieces.groupBy("entity", "shard").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("run").alias("run"))
    by_shard = Window.partitionBy("entity").orderBy("shard")
    level = hulls.withColumns(
        {
            "covered_to": F.max("e").over(by_shard.rowsBetween(Window.unboundedPreceding, -1)),
            "filled": F.max("run").over(by_shard.rowsBetween(Window.unboundedPreceding, 0)) >= F.col("shard"),
        }
    )
    between = level.filter(F.col("s") > F.col("covered_to")).select(
        "entity", _shard(F.col("covered_to"), edges).alias("shard"), F.col("covered_to").alias("gap_from"), F.col("s").alias("gap_to")
    )
    seen = inner.join(level.filter("filled").select("entity", "shard"), ["entity", "shard"], "left_anti")
    gaps = seen.select("entity", "shard", "gap_from", "gap_to").unionByName(between)
    return gaps, hulls.groupBy("entity").agg(F.min("s").alias("low"), F.max("e").alias("high"))


def find_gaps(df: DataFrame, entity: str, start: str, end: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Maximal uncovered stretches between covered time: (entity, gap_from_us, gap_to_us).

    Half-open intervals that touch leave no gap. An empty table, or an entity whose intervals are
    all empty, gives no rows. Repeated rows change nothing. Other columns of ``df`` are not read.
    """
    gaps, _ = gaps_and_hulls(normalise(df, entity, start, end), shard_edges(df, start, shard_rows))
    return gaps.select(F.col("entity").alias(entity), F.col("gap_from").alias("gap_from_us"), F.col("gap_to").alias("gap_to_us"))


def find_periods(df: DataFrame, entity: str, start: str, end: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Continuous periods without overlap: (entity, period_from_us, period_to_us), null if unbounded.

    The complement of the gaps inside the entity's hull, again on two levels: within a shard each
    period starts where the gap before it ended, the first of a shard where the last gap of an
    earlier shard ended.
    """
    gaps, hulls = gaps_and_hulls(normalise(df, entity, start, end), shard_edges(df, start, shard_rows))
    inside = Window.partitionBy("entity", "shard").orderBy("gap_from")
    last = gaps.groupBy("entity", "shard").agg(F.max("gap_to").alias("last_to"))
    earlier = Window.partitionBy("entity").orderBy("shard")
    last = last.withColumn("earlier_to", F.lag("last_to").over(earlier))
    bounds = hulls.select("entity", "low", "high")
    ended = (
        gaps.withColumn("own", F.lag("gap_to").over(inside))
        .join(last.select("entity", "shard", "earlier_to"), ["entity", "shard"])
        .join(bounds.select("entity", "low"), "entity")
        .select("entity", F.coalesce("own", "earlier_to", "low").alias("s"), F.col("gap_from").alias("e"))
    )
    final = bounds.join(last.groupBy("entity").agg(F.max("last_to").alias("last_to")), "entity", "left").select(
        "entity", F.coalesce("last_to", "low").alias("s"), F.col("high").alias("e")
    )
    every = ended.unionByName(final)
    return every.select(
        F.col("entity").alias(entity),
        F.when(F.col("s") > UNBOUNDED_FROM, F.col("s")).alias("period_from_us"),
        F.when(F.col("e") < UNBOUNDED_TO, F.col("e")).alias("period_to_us"),
    )
