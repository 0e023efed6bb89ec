"""Checks before a query runs: settings, tables, ranges, inputs and addresses."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from datetime import datetime
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from palimpsest.operators.feedback import CONTENT, RETRIEVAL

#: The layout of tables that this version reads and writes.
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Settings:
    """Limits of the engine; every one can be set by an environment variable of its name."""

    lexical_candidates: int = 100
    semantic_candidates: int = 100
    rerank_candidates: int = 30
    embed_batch: int = 8
    rerank_batch: int = 4
    count_batch: int = 64
    rerank_chars: int = 32_000
    models_enabled: bool = True


def load_settings(environment: Mapping[str, str] = os.environ, prefix: str = "PALIMPSEST_") -> Settings:
    """Settings from the environment; a value that does not fit its type, or is not positive, raises."""
    found = {}
    for f in fields(Settings):
        text = environment.get(prefix + f.name.upper())
        if text is None:
            continue
        if isinstance(f.default, bool):
            if text.lower() not in ("true", "false"):
                raise ValueError(f"{f.name}: true or false, not {text!r}")
            found[f.name] = text.lower() == "true"
        else:
            if not re.fullmatch(r"[1-9]\d*", text):
                raise ValueError(f"{f.name}: a positive number, not {text!r}")
            found[f.name] = int(text)
    return Settings(**found)


def check_table(df: DataFrame, expected: str) -> DataFrame:
    """``df`` if it has the columns of the schema ``expected``, whatever else it has."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in T._parse_datatype_string(expected).fields:
        if have.get(f.name) != f.dataType:
            raise TypeError(f"column {f.name}: {f.dataType.simpleString()} expected, {have[f.name].simpleString() if f.name in have else 'nothing'} found")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that differing rows share; redelivered rows, equal in every column, are no conflict."""
    return df.select(*keys, F.xxhash64(*df.columns).alias("_h")).groupBy(*keys).agg(F.count_distinct("_h").alias("n_versions")).filter("n_versions > 1")


def check_range(start: datetime | None, end: datetime | None) -> None:
    if start is not None and end is not None and not start < end:
        raise ValueError("a range must end after it starts")


def check_space(spaces: DataFrame, space: str) -> None:
    """Raises where a space is missing or deleted."""
    row = spaces.filter(F.col("id") == space).select("deleted_at").first()
    if row is None:
        raise LookupError(f"no space {space}")
    if row["deleted_at"] is not None:
        raise LookupError(f"space {space} is deleted")


@dataclass(frozen=True)
class Rule:
    """What an input may be: its kind, its length or range, the values it can take."""

    kind: type | tuple[type, ...]
    least: float | None = None
    most: float | None = None
    values: tuple = ()
    pattern: str | None = None
    required: bool = False
    each: "Rule | None" = None


# Lengths, counts and ranges of inputs, and the words they can be.
_KEY, _SPACE, _ACTOR, _NOTE, _QUESTION, _CURSOR = Rule(str, 1, 500), Rule(str, 1, 200), Rule(str, 1, 200), Rule(str, 0, 4_000), Rule(str, 1, 10_000), Rule(str, 0, 2_000)
_KIND, _TAG, _SHARE, _FLAG, _WHEN = Rule(str, 0, 100), Rule(str, 1, 100), Rule((int, float), 0, 1), Rule(bool), Rule(datetime)
_ID = Rule(str, pattern=r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_CONTENT_CHARS = 1_000_000


def _must(rule: Rule) -> Rule:
    return replace(rule, required=True)


def _many(rule: Rule, most: int, least: int = 0) -> Rule:
    return Rule(list, least, most, each=rule)


def _page(most: int) -> dict[str, Rule]:
    return {"size": Rule(int, 1, most), "cursor": _CURSOR}


_RECORD = {
    "space_id": _SPACE, "title": Rule(str, 0, 500), "kind": _KIND, "content_json": _must(Rule(str, 1, _CONTENT_CHARS)), "tags": _many(_TAG, 100), "sources": _many(Rule(dict), 100), "salience": _SHARE, "confidence": _SHARE,
    "observed_at": _WHEN, "valid_from": _WHEN, "valid_to": _WHEN, "expires_at": _WHEN, "review_after": _WHEN, "idempotency_key": _KEY, "actor": _ACTOR,
}

#: Inputs by command.
RULES: dict[str, dict[str, Rule]] = {
    "create_space": {"space_id": _SPACE, "name": _must(_SPACE), "description": Rule(str, 0, 2_000)},
    "list_spaces": {"space_id": _SPACE, "query": Rule(str, 1, 2_000), "state": Rule(str, values=("active", "deleted")), **_page(100)},
    "delete_space": {"space_id": _must(_SPACE)},
    "restore_space": {"space_id": _must(_SPACE)},
    "create": {**_RECORD, "logical_key": _KEY},
    "revise": {**_RECORD, "memory_id": _must(_ID), "expected_revision_id": _must(_ID)},
    "merge": {"canonical_id": _must(_ID), "canonical_revision_id": _must(_ID), "duplicates": _must(_many(_ID, 50, 1)), "actor": _ACTOR, "reason": _NOTE, "idempotency_key": _KEY},
    "get": {"memory_id": _must(_ID), "revision_id": _ID, "at": _WHEN},
    "get_by_key": {"space_id": _SPACE, "logical_key": _must(_KEY), "at": _WHEN},
    "history": {"memory_id": _must(_ID), "content": _FLAG, **_page(100)},
    "list": {"space_id": _SPACE, "state": Rule(str, values=("active", "archived")), "kind": _KIND, "tags": _many(Rule(str), 100), "feedback_status": Rule(str, values=("unreviewed", "supported", "verified", "needs-review")), **_page(200)},
    "search": {
        "query": _must(_QUESTION), "spaces": _many(Rule(str), 100), "states": _many(Rule(str, values=("active", "archived")), 3, 1), "kinds": _many(Rule(str), 100), "tags": _many(Rule(str), 100),
        "min_confidence": _SHARE, "min_salience": _SHARE, "k": Rule(int, 1, 50), "mode": Rule(str, values=("auto", "fast", "quality", "lexical", "semantic")), "at": _WHEN, "valid_at": _WHEN, "expand": _FLAG,
    },
    "archive": {"memory_id": _must(_ID)},
    "restore": {"memory_id": _must(_ID)},
    "delete": {"memory_id": _must(_ID)},
    "link": {"src": _must(_ID), "dst": _must(_ID), "relation": _must(Rule(str, 1, 200)), "valid_from": _WHEN, "valid_to": _WHEN},
    "unlink": {"link_id": _must(_ID)},
    "traverse": {"memory_id": _must(_ID), "depth": Rule(int, 0, 5), "at": _WHEN, "relations": _many(Rule(str, 1, 200), 50), "direction": Rule(str, values=("out", "in", "both")), "query": _QUESTION, **_page(200)},
    "feedback": {
        "memory_id": _must(_ID), "revision_id": _ID, "scope": _must(Rule(str, values=("content", "retrieval"))), "signal": _must(Rule(str, values=(*CONTENT, *RETRIEVAL))),
        "actor_type": _must(Rule(str, values=("user", "agent", "system", "external"))), "actor": _ACTOR, "query": _QUESTION, "note": _NOTE, "idempotency_key": _KEY,
    },
    "list_feedback": {"memory_id": _must(_ID), "revision_id": _ID, "scope": Rule(str, values=("legacy", "content", "retrieval")), "at": _WHEN, **_page(100)},
    "status": {"probe_models": _FLAG, "details": _FLAG},
}


def problems(command: str, values: Mapping) -> list[str]:
    """What is wrong with the inputs of a command; empty if nothing is."""
    rules = RULES[command]
    found = [f"{name}: unknown" for name in values if name not in rules]
    for name, rule in rules.items():
        if name not in values or values[name] is None:
            if rule.required:
                found.append(f"{name}: missing")
        elif said := _problem(rule, values[name]):
            found.append(f"{name}: {said}")
    return found


def _problem(rule: Rule, value) -> str | None:
    if not isinstance(value, rule.kind) or isinstance(value, bool) != (rule.kind is bool):
        return "wrong type"
    if isinstance(value, (bool, datetime)):
        return None
    size = value if isinstance(value, (int, float)) else len(value)
    if rule.least is not None and size < rule.least or rule.most is not None and size > rule.most:
        return f"not between {rule.least} and {rule.most}"
    if rule.values and value not in rule.values:
        return f"none of {', '.join(map(str, rule.values))}"
    if rule.pattern and not re.fullmatch(rule.pattern, value):
        return "wrong form"
    if rule.each:
        return next((f"item {i} {said}" for i, x in enumerate(value) if (said := _problem(rule.each, x))), None)
    return None


def address(space: str, memory: str, history: bool = False) -> str:
    """The address of a record, its parts percent-encoded."""
    return f"memory://spaces/{quote(space, safe='')}/memories/{quote(memory, safe='')}" + "/history" * history


def parts_of(uri: str) -> tuple[str, str, bool]:
    """(space, memory, asks for the history) of an address."""
    found = re.fullmatch(r"memory://spaces/([^/]+)/memories/([^/]+)(/history)?", uri)
    if not found:
        raise ValueError(f"not an address: {uri}")
    return unquote(found[1]), unquote(found[2]), bool(found[3])


def read_address(revisions: DataFrame, uri: str) -> DataFrame:
    """The current revision at an address, or all its revisions, newest first; the space must be the
    one the record is in."""
    space, memory, history = parts_of(uri)
    own = revisions.filter((F.col("memory_id") == memory) & (F.col("space_id") == space)).dropDuplicates(["id"]).orderBy(F.desc("revision_number"), F.desc("id"))
    if own.isEmpty():
        raise LookupError(uri)
    return own if history else own.limit(1)


def write_version(spark: SparkSession, folder: str, version: int = SCHEMA_VERSION) -> None:
    """Marks a folder of tables with their layout's version."""
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_version")


def migrate(spark: SparkSession, folder: str, steps: Mapping[int, object], target: int = SCHEMA_VERSION) -> int:
    """Runs the steps (version -> function of session and folder) that lead from the folder's version
    to ``target``, marking each; a newer folder raises, a folder without mark counts as version 0."""
    try:
        now = spark.read.parquet(f"{folder}/_version").first()["version"]
    except Exception as e:  # noqa: BLE001 - only a missing mark is version 0
        if "PATH_NOT_FOUND" not in str(e):
            raise
        now = 0
    if now > target:
        raise ValueError(f"the tables have layout {now}, newer than {target}")
    for version in range(now + 1, target + 1):
        steps[version](spark, folder)
        write_version(spark, folder, version)
    return target
