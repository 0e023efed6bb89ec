"""Records as text: the fields of their content, metadata and sources, and index segments of those."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.functions.json_index import build as build_value, parse, record_text
from palimpsest.functions.json_text import leaves
from palimpsest.functions.text import estimate_tokens, header
from palimpsest.operators import segments

FIELDS = "record_id string, ordinal int, path string, text string"


def source_lines(sources: str | Column) -> Column:
    """``sources/<index>/<member>: value`` of the plain members of each source, in their order."""
    at = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def lines(source: Column, index: Column) -> Column:
        members = [("uri", source["uri"]), ("label", source["label"]), ("type", source["type"]), ("observedAt", at(source["observed_at"]))]
        shown = [F.concat(F.lit("sources/"), index.cast("string"), F.lit(f"/{name}: "), F.nullif(value, F.lit(""))) for name, value in members]
        return F.filter(F.array(*shown), lambda x: x.isNotNull())

    return F.flatten(F.transform(sources, lines))


def _json_fields(value: str | None, prefix: str) -> list[tuple[str, str]]:
    text = record_text(value) or value
    if not text:
        return []
    ok, parsed = parse(text)
    if not ok:
        return []
    if parsed is None and text.strip() != "null":
        parsed = build_value(text)
    return [(prefix + path[1:] if prefix != "$" else path, leaf) for path, leaf in leaves(parsed)]


def _utf8(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def _of_sources(value: str | None) -> Iterator[tuple[str, str]]:
    for i, source in enumerate(json.loads(value) if value else []):
        for name in ("uri", "label", "type", "observedAt"):
            if source and source.get(name):
                yield f"sources/{i}/{name}", source[name]
        if source and source.get("metadata"):
            yield from _json_fields(source["metadata"], f"sources/{i}/metadata")


def _fields(content: str | None, metadata: str | None, sources: str | None) -> list[tuple[str, str]]:
    found = [*_json_fields(content, "$"), *_json_fields(metadata, "metadata"), *_of_sources(sources)]
    return [(_utf8(path), _utf8(text)) for path, text in found]


def _narrow(df: DataFrame, *more: Column) -> DataFrame:
    at = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    members = lambda s: F.struct(s["uri"].alias("uri"), s["label"].alias("label"), s["type"].alias("type"), at(s["observed_at"]).alias("observedAt"), s["metadata"].alias("metadata"))
    return df.select(F.col("id").alias("record_id"), "content_json", "metadata_json", F.to_json(F.transform("sources", members)).alias("sources"), *more).filter("record_id IS NOT NULL")


def fields(df: DataFrame) -> DataFrame:
    """(record_id, ordinal, path, text) of every field of ``df`` (id, content_json, metadata_json,
    sources): content first, then metadata, then sources; unreadable values have no fields."""
    target = T._parse_datatype_string(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record, *values in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                rows.extend((record, i, path, text) for i, (path, text) in enumerate(_fields(*values)))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=target.names)

    return _narrow(df).mapInArrow(run, target)


def field_segments(df: DataFrame) -> DataFrame:
    """(segment_id, record_id, ordinal, path, text, token_count, content_hash): the index segments of
    ``df`` (id, title, kind, tags, content_json, metadata_json, sources), numbered in field order,
    each under the head lines; a record without fields has one with the head alone."""
    target = T._parse_datatype_string(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record, content, metadata, sources, head in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                pieces = [(path, piece) for path, text in _fields(content, metadata, sources) for piece in segments.within_tokens(segments.pack(text))]
                for i, (path, piece) in enumerate(pieces or [("$", "")]):
                    rows.append((record, i, path, f"{head}\n{path}: {piece}" if head else f"{path}: {piece}"))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=target.names)

    cut = _narrow(df, header("title", "kind", "tags").alias("head")).mapInArrow(run, target)
    return cut.select(
        F.concat_ws(":", "record_id", "ordinal").alias("segment_id"), "record_id", "ordinal", "path", "text",
        estimate_tokens("text").alias("token_count"), F.sha2("text", 256).alias("content_hash"),
    )


def of_record(segments_table: DataFrame, record: str) -> DataFrame:
    """The segments of one record, in order."""
    return segments_table.filter(F.col("record_id") == record).orderBy("ordinal")


def first_segments(segments_table: DataFrame) -> DataFrame:
    """Each record's first segment."""
    from palimpsest.operators.temporal import latest

    return latest(segments_table, ["record_id"], [F.asc("ordinal")])
