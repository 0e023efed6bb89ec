"""Deeply nested JSON as flat tables that keep parent-child links."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest.functions.json_index import array_objects, build, parse, record_text, step

#: Characters of records indexed at once; bounds a task's memory, not what is read.
BATCH_CHARS = 4_000_000

SCHEMA = "table_name string, field string, record_id string, path string, parent_path string, ordinal int, members map<string,string>, inner map<string,string>"
LINKS = "table_name string, field string, record_id string, path string, parent_path string"


def _utf8(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def _shown(x) -> str | None:
    return None if x is None else _utf8(x if isinstance(x, str) else json.dumps(x))


def _contents(text: str) -> tuple[list[tuple[str, str | None]], list[tuple[str, str | None]]]:
    """(scalar members, inner values) of an object as text.

    Inner values are the scalars of nested objects and of arrays, and empty containers, under their
    path relative to the object (``args/x``, ``tags/0``); objects inside arrays have rows of their own.
    """
    ok, value = parse(text)
    if ok and value is None:
        value = build(text)
    if not ok or not isinstance(value, dict):
        return [], []
    members, inner, stack = [], [], []
    for key, x in value.items():
        if isinstance(x, (dict, list)):
            stack.append((step(key), x))
        else:
            members.append((_utf8(key), _shown(x)))
    stack.reverse()
    while stack:
        at, x = stack.pop()
        if isinstance(x, dict) and x:
            stack.extend((f"{at}/{step(k)}", v) for k, v in reversed(x.items()))
        elif isinstance(x, list) and x:
            stack.extend((f"{at}/{i}", x[i]) for i in range(len(x) - 1, -1, -1) if not isinstance(x[i], dict))
        else:
            inner.append((_utf8(at), _shown(x)))
    return members, inner


def flatten(df: DataFrame, table_name: str, id_column: str, fields: list[str], members: bool = True) -> DataFrame:
    """One row per object found directly inside an array of any of the JSON ``fields``.

    Gives table_name, field, record_id, path, parent_path (the nearest enclosing object that is
    such a row, else ``$``) and, with ``members``, the ordinal in its array, the object's scalar
    members and, as ``inner``, the values of its nested objects and arrays by relative path. Values
    that are null, empty or no valid JSON give no rows; a value that is a JSON string holding an
    object or array is that object or array. Redelivered rows (same id) count once, rows with a null
    id have nothing to link to and give none. Other columns are not read.
    """
    narrow = df.select(F.col(id_column).alias("record_id"), *[F.col(f).alias(f"v{i}") for i, f in enumerate(fields)])
    # Only text that can hold an object inside an array is worth moving to Python.
    for i in range(len(fields)):
        v = F.col(f"v{i}")
        # A JSON string may write its brackets as escapes.
        escaped = v.rlike(r'^[ \t\n\r]*"') & v.rlike(r"(?i)\\u00[57]b")
        narrow = narrow.withColumn(f"v{i}", F.when((v.contains("[") & v.contains("{")) | escaped, v))
    narrow = narrow.filter(F.col("record_id").isNotNull() & F.coalesce(*[F.col(f"v{i}") for i in range(len(fields))]).isNotNull())
    narrow = narrow.dropDuplicates(["record_id"])

    target = T._parse_datatype_string(SCHEMA if members else LINKS)
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, name in enumerate(names):
                texts, owners, size = [], [], 0
                for owner, value in zip(ids, batch.column(i + 1).to_pylist()):
                    text = record_text(value)
                    if text is not None:
                        texts.append(text)
                        owners.append(owner)
                        size += len(text)
                    if size >= BATCH_CHARS:
                        yield from emit(name, texts, owners)
                        texts, owners, size = [], [], 0
                yield from emit(name, texts, owners)

    def emit(name: str, texts: list[str], owners: list[str]) -> Iterator[pa.RecordBatch]:
        # A repeated key makes two objects share a path; that place gives one row.
        found = list({(row[0], row[1]): row for row in array_objects(texts)}.values())
        for low in range(0, len(found), 50_000):
            part = found[low : low + 50_000]
            columns = [
                pa.array([table_name] * len(part), pa.string()),
                pa.array([name] * len(part), pa.string()),
                pa.array([owners[r] for r, *_ in part], pa.string()),
                pa.array([p for _, p, *_ in part], pa.string()),
                pa.array([p for _, _, p, *_ in part], pa.string()),
            ]
            if members:
                columns.append(pa.array([n for *_, n, _ in part], pa.int32()))
                contents = [_contents(t) for *_, t in part]
                columns.extend(pa.array([c[i] for c in contents], pa.map_(pa.string(), pa.string())) for i in range(2))
            yield pa.RecordBatch.from_arrays(columns, names=target.names)

    return narrow.mapInArrow(run, target)


def flat_table(objects: DataFrame, array_path: str, columns: dict[str, str]) -> DataFrame:
    """A typed relation of the objects in one array, e.g. ``$/timeline`` or ``$/rules/*/except``.

    ``*`` stands for any one step. ``columns`` maps member names to Spark types; an absent or
    unreadable member is null. Nested values stay in ``inner``, parent links in record_id, path and
    parent_path.
    """
    pattern = "/".join("[^/]+" if step == "*" else f"\\Q{step}\\E" for step in array_path.split("/")) + "/[0-9]+"
    return objects.filter(F.col("path").rlike(f"^{pattern}$")).select(
        "table_name", "field", "record_id", "path", "parent_path", "ordinal",
        *[F.try_element_at("members", F.lit(name)).try_cast(kind).alias(name) for name, kind in columns.items()], "inner",
    )
