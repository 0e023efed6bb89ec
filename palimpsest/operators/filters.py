"""Predicates over revisions and memories."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.operators import temporal

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def literal(value: str) -> str:
    """A key or query as it is compared: NFKC, without white space around it."""
    return unicodedata.normalize("NFKC", value).strip()


def nocase(column: str | Column) -> Column:
    """ASCII case folding, letters beyond A-Z untouched."""
    return F.translate(column, _UPPER, _LOWER)


def nocase_equal(column: str | Column, value: str) -> Column:
    return nocase(column) == "".join(_LOWER[_UPPER.index(c)] if c in _UPPER else c for c in value)


def prefix_nocase(column: str | Column, prefix: str) -> Column:
    """A literal, case-insensitive prefix: no character of it is a wildcard."""
    return nocase(column).startswith("".join(_LOWER[_UPPER.index(c)] if c in _UPPER else c for c in prefix))


def normalise_tags(tags: str | Column) -> Column:
    """Trimmed, lower-cased, without empty ones and repeats, sorted."""
    lowered = F.transform(tags, lambda t: F.lower(F.trim(t)))
    return F.array_sort(F.array_distinct(F.filter(lowered, lambda t: t.isNotNull() & (t != ""))))


def all_tags(tags: str | Column, wanted: list[str]) -> Column:
    """Every wanted tag is among the tags."""
    clean = sorted({t.strip().lower() for t in wanted} - {""})
    if not clean:
        return F.lit(True)
    return F.coalesce(F.size(F.array_intersect(normalise_tags(tags), F.array(*[F.lit(t) for t in clean]))) == len(clean), F.lit(False))


def keyset_after(keys: list[tuple[str, bool]], values: list) -> Column:
    """Rows strictly after the cursor row; keys are (column, is ascending), the last one unique."""
    after, same = F.lit(False), F.lit(True)
    for (name, ascending), value in zip(keys, values):
        here = F.lit(value) if not isinstance(value, Column) else value
        step = F.col(name) > here if ascending else F.col(name) < here
        after = after | (same & step)
        same = same & (F.col(name) == here)
    return after


@dataclass(frozen=True)
class Candidates:
    """The filter that every retrieval channel shares. None means no restriction; an empty list of
    spaces means nothing."""

    now: str
    at_time: str | None = None
    valid_at: str | None = None
    spaces: list[str] | None = None
    states: list[str] = field(default_factory=lambda: ["active"])
    kinds: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    min_confidence: float | None = None
    min_salience: float | None = None


def scored(wanted: Candidates) -> Column:
    """Kind and scores; a null score is below any bound."""
    keep = F.col("kind").isin(wanted.kinds) if wanted.kinds else F.lit(True)
    if wanted.min_confidence is not None:
        keep = keep & (F.col("confidence") >= wanted.min_confidence)
    if wanted.min_salience is not None:
        keep = keep & (F.col("salience") >= wanted.min_salience)
    return keep


def listed(memories: DataFrame, heads: DataFrame, space: str | None = None, state: str = "active", kind: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """(id, space_id, updated_at, title, kind) of the memories in a state, with what their current
    revision ``heads`` (id, title, kind, tags) says; every other restriction is optional."""
    own = memories.filter(F.col("state") == state)
    if space is not None:
        own = own.filter(F.col("space_id") == space)
    keep = F.col("kind") == kind if kind is not None else F.lit(True)
    current = heads.filter(keep & all_tags("tags", tags or [])).select(F.col("id").alias("current_revision_id"), "title", "kind")
    return own.join(current, "current_revision_id").select("id", "space_id", "updated_at", "title", "kind").dropDuplicates(["id"])


def candidates(revisions: DataFrame, events: DataFrame, spaces: DataFrame, wanted: Candidates) -> DataFrame:
    """Revisions that retrieval may return: the current ones, or those of ``at_time``.

    With ``at_time`` and without ``valid_at`` validity is not asked for; expiry always is.
    """
    heads = temporal.revisions_as_of(revisions, wanted.at_time)
    states = temporal.states_as_of(events, wanted.at_time).filter(F.col("state").isin(wanted.states)).select("memory_id")
    active = spaces.filter(F.col("deleted_at").isNull()).select(F.col("id").alias("space_id")).distinct()
    keep = temporal.unexpired(wanted.at_time or wanted.now) & scored(wanted)
    point = wanted.valid_at or (None if wanted.at_time else wanted.now)
    if point:
        keep = keep & temporal.valid_at(point)
    if wanted.spaces is not None:
        keep = keep & (F.col("space_id").isin(wanted.spaces) if wanted.spaces else F.lit(False))
    if wanted.tags:
        keep = keep & all_tags("tags", wanted.tags)
    return heads.filter(keep).join(states, "memory_id", "left_semi").join(active, "space_id", "left_semi")


def readable(df: DataFrame, grants: DataFrame, principal: str, level: int, cap: int | None = None) -> DataFrame:
    """Rows of the spaces ``principal`` may use at ``level``. A grant of a space overrides that of
    ``*``; no grant reaches beyond ``cap``, what the caller's token allows. ``grants``: (principal,
    space_id, level)."""
    if cap is not None and cap < level:
        return df.limit(0)
    own = grants.filter(F.col("principal") == principal)
    star = own.filter(F.col("space_id") == "*").agg(F.coalesce(F.max("level"), F.lit(0)).alias("star"))
    named = own.filter(F.col("space_id") != "*").groupBy("space_id").agg(F.max("level").alias("named"))
    granted = df.join(named, "space_id", "left").withColumn("star", star.scalar())
    return granted.filter(F.coalesce("named", "star") >= level).drop("named", "star")
