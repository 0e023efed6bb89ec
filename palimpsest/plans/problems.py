"""Queries of the general data-processing problems and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.operators import intervals, nested, references
from palimpsest.sources.tables import read


def p2_objects(spark: SparkSession, sf_dir: str, members: bool = True) -> DataFrame:
    """Every JSON object inside an array with all that it holds itself."""
    revisions = nested.flatten(read(spark, sf_dir, "memory_revisions"), "memory_revisions", "id", ["content_json", "metadata_json"], members)
    spaces = nested.flatten(read(spark, sf_dir, "spaces"), "spaces", "id", ["metadata_json"], members)
    return revisions.unionByName(spaces)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per JSON object inside an array, linked to its record and holder."""
    return p2_objects(spark, sf_dir, members=False)


def p2_flat_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed flat table: the steps of every record's ``timeline``."""
    return nested.flat_table(p2_objects(spark, sf_dir), "$/timeline", {"at": "timestamp", "event": "string", "actors": "string"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in the validity of every memory."""
    return intervals.find_gaps(read(spark, sf_dir, "memory_revisions"), "memory_id", "valid_from", "valid_to")


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous validity periods of every memory."""
    return intervals.find_periods(read(spark, sf_dir, "memory_revisions"), "memory_id", "valid_from", "valid_to")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories, revisions = read(spark, sf_dir, "memories"), read(spark, sf_dir, "memory_revisions")
    events, spaces = read(spark, sf_dir, "memory_state_events"), read(spark, sf_dir, "spaces")
    # A memory counts as deleted for references after its deletion, a space from its deletion on.
    memory_gone = F.when(F.col("state") == "deleted", F.col("updated_at") + F.expr("INTERVAL 1 MICROSECOND"))
    refs = (
        references.references(revisions, "memory_revisions", "memory_id", "recorded_at", target="memory")
        .unionByName(references.references(events, "memory_state_events", "memory_id", "recorded_at", target="memory"))
        .unionByName(references.references(memories, "memories", "current_revision_id", "updated_at", target="revision"))
        .unionByName(references.references(memories, "memories", "space_id", "created_at", target="space"))
    )
    tables = {"memory": memories, "revision": revisions, "space": spaces}
    keys = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("target"), F.col("id").alias("key")) for name, df in tables.items()])
    targets = (
        references.parents(memories, "created_at", memory_gone, target="memory")
        .unionByName(references.parents(revisions, "recorded_at", target="revision"))
        .unionByName(references.parents(spaces, "created_at", F.col("deleted_at"), target="space"))
    )
    size = sum(df.count() for df in tables.values())  # footers: it only sizes the filter
    return references.find_orphans(refs, targets, size, keys=keys)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references one by one."""
    return _orphans(spark, sf_dir).select("table_name", "field", "record_id", "reason")


def p6_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references per table, field, month and reason."""
    return references.per_month(_orphans(spark, sf_dir))


_P3_BASE = """
WITH iv AS (
  SELECT memory_id,
         coalesce(epoch_us(valid_from), -4611686018427387904) AS s,
         coalesce(epoch_us(valid_to), 4611686018427387904) AS e
  FROM memory_revisions WHERE memory_id IS NOT NULL
), kept AS (
  SELECT DISTINCT * FROM iv WHERE s < e
), seen AS (
  SELECT memory_id, s, e,
         max(e) OVER (PARTITION BY memory_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered_to
  FROM kept
)"""

_P6_BASE = """
WITH spc AS (SELECT id, min(created_at) AS created, min(deleted_at) AS gone FROM spaces GROUP BY id),
mem AS (SELECT id, min(created_at) AS created,
               min(CASE WHEN state = 'deleted' THEN updated_at END) AS gone FROM memories GROUP BY id),
rev AS (SELECT id, min(recorded_at) AS created FROM memory_revisions GROUP BY id),
refs AS (
  SELECT DISTINCT 'memories' AS table_name, 'space_id' AS field, id AS record_id, space_id AS k, created_at AS t FROM memories
  UNION ALL SELECT DISTINCT 'memories', 'current_revision_id', id, current_revision_id, updated_at FROM memories
  UNION ALL SELECT DISTINCT 'memory_revisions', 'memory_id', id, memory_id, recorded_at FROM memory_revisions
  UNION ALL SELECT DISTINCT 'memory_state_events', 'memory_id', id, memory_id, recorded_at FROM memory_state_events
), judged AS (
  SELECT r.*, CASE
    WHEN field = 'space_id' THEN CASE WHEN s.id IS NULL THEN 'missing' WHEN s.gone <= t THEN 'deleted' WHEN s.created > t THEN 'late' END
    WHEN field = 'current_revision_id' THEN CASE WHEN v.id IS NULL THEN 'missing' WHEN v.created > t THEN 'late' END
    ELSE CASE WHEN m.id IS NULL THEN 'missing' WHEN m.gone < t THEN 'deleted' WHEN m.created > t THEN 'late' END
  END AS reason
  FROM refs r
  LEFT JOIN spc s ON field = 'space_id' AND s.id = r.k
  LEFT JOIN rev v ON field = 'current_revision_id' AND v.id = r.k
  LEFT JOIN mem m ON field = 'memory_id' AND m.id = r.k
  WHERE r.k IS NOT NULL
)"""

# DuckDB also reads trailing commas and undefined numbers, which are no JSON.
_READABLE = r"""json_valid({x}) AND NOT regexp_matches(regexp_replace({x}, '"(\\.|[^"\\])*"', '""', 'g'), ',\s*[}}\]]|NaN|Infinity|inf|nan')"""


def json_nodes(source: str) -> str:
    """CTEs ending in ``node(t, f, id, path, holder, is_row, v)`` of the records in ``source(t, f, id, x)``:
    every JSON value with its path; rows are objects directly in arrays, holders the rows around."""
    return f"""rec AS ({source}), val AS (SELECT t, f, id, CASE WHEN json_type(x) = 'VARCHAR' THEN CASE WHEN {_READABLE.format(x="(x ->> '$')")} AND json_type(x ->> '$') IN ('OBJECT', 'ARRAY') THEN (x ->> '$')::JSON ELSE x::JSON END ELSE x::JSON END AS v
  FROM rec WHERE {_READABLE.format(x="x")}),
node AS (SELECT t, f, id, '$' AS path, '$' AS holder, FALSE AS is_row, v FROM val
 UNION ALL SELECT t, f, id, path || '/' || k, CASE WHEN is_row THEN path ELSE holder END, is_array AND json_type(v, '/' || k) = 'OBJECT', json_extract(v, '/' || k) FROM (
  SELECT *, json_type(v) = 'ARRAY' AS is_array, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_distinct(list_transform(json_keys(v), lambda k: replace(replace(k, '~', '~0'), '/', '~1')))
   WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: i::VARCHAR) ELSE [] END) AS k FROM node))"""


_P2_SOURCE = """SELECT 'memory_revisions' AS t, 'content_json' AS f, id, content_json AS x FROM (SELECT DISTINCT ON (id) * FROM memory_revisions) UNION ALL
 SELECT 'memory_revisions', 'metadata_json', id, metadata_json FROM (SELECT DISTINCT ON (id) * FROM memory_revisions) UNION ALL SELECT 'spaces', 'metadata_json', id, metadata_json FROM spaces"""

SQL = {
    "p2_found": f"WITH RECURSIVE {json_nodes(_P2_SOURCE)} SELECT t AS table_name, f AS field, id AS record_id, path, holder AS parent_path FROM node WHERE is_row",
    "p3_found": _P3_BASE + " SELECT memory_id, covered_to AS gap_from_us, s AS gap_to_us FROM seen WHERE s > covered_to",
    "p3_periods": _P3_BASE
    + """, starts AS (
  SELECT memory_id, s, e, sum(CASE WHEN covered_to IS NULL OR s > covered_to THEN 1 ELSE 0 END)
         OVER (PARTITION BY memory_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen
), islands AS (SELECT memory_id, island, min(s) AS s, max(e) AS e FROM starts GROUP BY memory_id, island)
SELECT memory_id, CASE WHEN s > -4611686018427387904 THEN s END AS period_from_us,
       CASE WHEN e < 4611686018427387904 THEN e END AS period_to_us FROM islands""",
    "p6_found": _P6_BASE + " SELECT table_name, field, record_id, reason FROM judged WHERE reason IS NOT NULL",
    "p6_per_month": _P6_BASE
    + " SELECT table_name, field, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS n_references FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
}

QUERIES = {
    "p2_found": p2_found,
    "p2_objects": p2_objects,
    "p2_flat_timeline": p2_flat_timeline,
    "p3_found": p3_found,
    "p3_periods": p3_periods,
    "p6_found": p6_found,
    "p6_per_month": p6_per_month,
}
