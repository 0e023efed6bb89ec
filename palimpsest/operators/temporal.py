"""Record-time and valid-time operators: as-of reads, heads, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def instant(value: str | Column) -> Column:
    """An evaluation instant; never the clock, so that results can be repeated."""
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; plans as a group limit before and after the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def revisions_as_of(revisions: DataFrame, at: str | None = None) -> DataFrame:
    """Each memory's revision with the highest number recorded by ``at`` (or ever)."""
    seen = revisions if at is None else revisions.filter(F.col("recorded_at") <= instant(at))
    return latest(seen, ["memory_id"], [F.desc("revision_number"), F.desc("id")])


def states_as_of(events: DataFrame, at: str | None = None) -> DataFrame:
    """Each memory's state by the latest event recorded by ``at`` (or ever): (memory_id, state, ...)."""
    seen = events if at is None else events.filter(F.col("recorded_at") <= instant(at))
    order = [F.desc("recorded_at"), F.desc("event_number"), F.desc("id")] if at is not None else [F.desc("event_number"), F.desc("id")]
    return latest(seen, ["memory_id"], order)


def valid_at(point: str | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity; null bounds are unbounded."""
    p = instant(point)
    return (F.col(start).isNull() | (F.col(start) <= p)) & (F.col(end).isNull() | (F.col(end) > p))


def unexpired(point: str | Column, column: str = "expires_at") -> Column:
    p = instant(point)
    return F.col(column).isNull() | (F.col(column) > p)


def live_at(point: str | Column) -> Column:
    """A link that exists, is not deleted and is valid at the instant."""
    p = instant(point)
    return (F.col("created_at") <= p) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > p)) & valid_at(point)
