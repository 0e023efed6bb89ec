"""JSON as searchable lines: leaves with their paths, canonical text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest.functions.json_index import parse, record_text


def leaves(value, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, text) of every scalar; null reads ``null``, empty containers have no line."""
    stack = [(path, value)]
    while stack:
        at, x = stack.pop()
        if isinstance(x, dict):
            stack.extend((f"{at}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in reversed(x.items()))
        elif isinstance(x, list):
            stack.extend((f"{at}/{i}", x[i]) for i in range(len(x) - 1, -1, -1))
        elif isinstance(x, str):
            yield at, x
        else:
            yield at, json.dumps(x)


def canonical(text: str | None) -> str | None:
    """The value with sorted keys and without spaces; null if it is not valid JSON."""
    if text is None:
        return None
    ok, value = parse(text)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if ok else None


def _utf8(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def flatten(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """(record_id, position, path, text) of the leaves of every record; unreadable values give none."""
    narrow = df.select(F.col(id_column).alias("record_id"), F.col(json_column).alias("value")).filter(F.col("record_id").isNotNull() & F.col("value").isNotNull())
    target = T._parse_datatype_string("record_id string, position int, path string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = record_text(value) or value
                ok, parsed = parse(text)
                if ok and not (parsed is None and text.strip() != "null"):
                    rows.extend((record, i, _utf8(p), _utf8(t)) for i, (p, t) in enumerate(leaves(parsed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=target.names)

    return narrow.mapInArrow(run, target)


def canonical_hash(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """(record_id, content_hash): SHA-256 of the canonical text."""
    narrow = df.select(F.col(id_column).alias("record_id"), F.col(json_column).alias("value"))
    target = T._parse_datatype_string("record_id string, canonical string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if (c := canonical(v)) is None else _utf8(c) for v in batch.column(1).to_pylist()], pa.string())], names=target.names
            )

    return narrow.mapInArrow(run, target).select("record_id", F.sha2("canonical", 256).alias("content_hash"))
