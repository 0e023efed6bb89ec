"""What results show: excerpts around a hit, documents for a reranker, compact JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Characters of an excerpt, of its head, and of a rerank document.
EXCERPT, EXCERPT_HEAD, RERANK_DOCUMENT = 2000, 400, 8000
HEAD_LINES = ("Title: ", "Kind: ", "Tags: ")


def with_excerpt(df: DataFrame, id_column: str, searchable: str, path: str, fallback: str, most: int = EXCERPT, most_head: int = EXCERPT_HEAD) -> DataFrame:
    """``df``, one row per id, with ``excerpt``: the line of the field at ``path`` and the lines of
    the same object's other fields, nearest first, as many as fit in ``most`` characters, in the
    text's order under its head lines (at most ``most_head`` characters). Where the field is not there, stands
    alone or does not fit, ``fallback`` cut to size. Null texts and paths count as empty.

    Lines are rows: a field's distance is its place among its object's fields, and running lengths
    by distance say what fits.
    """
    texts = df.select(F.col(id_column).alias("_id"), F.coalesce(path, F.lit("")).alias("_path"), F.split(F.coalesce(searchable, F.lit("")), "\n").alias("_l"))
    lines = texts.select("_id", "_path", F.posexplode("_l").alias("_at", "_line"))
    starts = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.startswith(F.col("_line"), w))
    holder = F.when(F.instr("_path", "/") > 1, F.regexp_replace("_path", "/[^/]*$", "")).otherwise(F.col("_path"))
    size = F.length("_line") + 1
    whole, sofar = Window.partitionBy("_id"), Window.partitionBy("_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)

    heads = lines.filter(starts(HEAD_LINES)).withColumn("_used", F.sum(size).over(sofar)).filter(F.col("_used") <= most_head + 1)
    taken = heads.groupBy("_id").agg(F.max("_used").alias("_head"))
    fields = lines.filter(F.startswith("_line", F.concat(holder, F.lit("/")))).withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("_at")))
    own = F.min(F.when(F.startswith("_line", F.concat("_path", F.lit(":"))), F.col("_n"))).over(whole)
    placed = fields.withColumn("_far", F.abs(F.col("_n") - own)).filter("_far IS NOT NULL").withColumn("_fields", F.count(F.lit(1)).over(whole))
    nearest = Window.partitionBy("_id").orderBy("_far", "_at").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.filter("_fields > 1").join(taken, "_id", "left").withColumn("_used", F.coalesce("_head", F.lit(0)) + F.sum(size).over(nearest)).filter(F.col("_used") <= most + 1)
    shown = near.select("_id", "_at", "_line").unionByName(heads.join(near.select("_id").distinct(), "_id", "left_semi").select("_id", "_at", "_line"))
    joined = shown.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_line"))), lambda x: x["_line"]), "\n").alias("_shown"))
    found = df.join(joined.withColumnRenamed("_id", id_column), id_column, "left")
    return found.withColumn("excerpt", F.coalesce("_shown", F.substring(F.coalesce(fallback, F.lit("")), 1, most))).drop("_shown")


def without_head(text: str | Column) -> Column:
    """A text without the head lines it begins with, which a result shows elsewhere."""
    return F.regexp_replace(text, r"^(Title: [^\n]*\n)?(Kind: [^\n]*\n)?(Tags: [^\n]*\n)?", "")


def rerank_document(evidence: Column) -> Column:
    """Title, kind, tags, scores, validity and sources, then the matched evidence, within a size."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    source = F.transform("sources", lambda s: F.concat_ws(" | ", F.nullif(s["label"], F.lit("")), F.nullif(s["type"], F.lit("")), F.nullif(s["uri"], F.lit(""))))
    named = F.array_join(F.filter(source, lambda s: s != ""), "; ")
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.substring(
        F.concat_ws(
            "\n", line("Title", F.nullif("title", F.lit(""))), line("Kind", F.nullif("kind", F.lit(""))), F.when(F.size("tags") > 0, line("Tags", F.array_join("tags", ", "))),
            line("Confidence", F.col("confidence").cast("string")), line("Salience", F.col("salience").cast("string")), line("Valid from", at("valid_from")),
            line("Valid to", at("valid_to")), line("Sources", F.nullif(named, F.lit(""))), F.lit("Matched evidence:"), evidence,
        ),
        1, RERANK_DOCUMENT,
    )


def payload_sources(sources: str | Column, observed_at: str | Column) -> Column:
    """Sources as a result shows them: the time of observation only where it is not the record's own."""
    own = F.col(observed_at) if isinstance(observed_at, str) else observed_at
    same = lambda s: s["observed_at"].eqNullSafe(own)
    return F.transform(sources, lambda s: s.withField("observed_at", F.when(~same(s), s["observed_at"])))


def payload(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` (id, ..., sources, observed_at, index_status) as (id, body): compact JSON of ``columns``, sources as
    :func:`payload_sources`, the index status only where it is not ``ready``."""
    shown = df
    if "sources" in columns:
        shown = shown.withColumn("sources", payload_sources("sources", "observed_at"))
    if "index_status" in columns:
        shown = shown.withColumn("index_status", F.nullif("index_status", F.lit("ready")))
    return shown.select("id", compact(columns, shown.schema).alias("body"))


def acknowledgement(done: DataFrame, outcome: str = "outcome") -> DataFrame:
    """(command_id, outcome, body) of judged commands: what a caller is told, without what is null."""
    told = [c for c in ("memory_id", "revision_id", "revision_number", "operation_id", "duplicate_id", "space_id") if c in done.columns]
    return done.select("command_id", F.col(outcome).alias("outcome"), compact(told, done.schema).alias("body"))


def compact(columns: list[str], schema: T.StructType) -> Column:
    """A row as JSON without nulls, empty strings and empty arrays."""
    shown = []
    for name in columns:
        kind = schema[name].dataType
        c = F.col(name)
        if isinstance(kind, T.StringType):
            c = F.nullif(c, F.lit(""))
        elif isinstance(kind, T.ArrayType):
            c = F.when(F.size(c) > 0, c)
        shown.append(c.alias(name))
    return F.to_json(F.struct(*shown))
