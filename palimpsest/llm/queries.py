"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import knn, leaks, mixture, near_duplicates, split, truncation
from palimpsest.sources.tables import read


def _limits(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    """Limits per field: one row per column of the split table at most."""
    columns = read(spark, sf_dir, "memory_revisions").columns
    limits = read(spark, sf_dir, "split_limits").filter(F.col("field").isin(columns)).groupBy("field").agg(F.min("max_chars").alias("m"), F.min("overlap_chars").alias("o"))
    return {r["field"]: (r["m"], r["o"]) for r in limits.collect()}


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every oversized content_json and searchable_text."""
    pieces = split.split_oversized(read(spark, sf_dir, "memory_revisions"), "id", _limits(spark, sf_dir))
    return pieces.withColumnRenamed("record_id", "revision_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were cut into pieces."""
    return p1_pieces(spark, sf_dir).filter(F.col("piece") == 0).select("revision_id", "field")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of segments of which one is among the five nearest of the other."""
    return knn.pairs(knn.nearest(read(spark, sf_dir, "memory_vectors")))


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy against brute force for one in a hundred segments."""
    vectors = read(spark, sf_dir, "memory_vectors")
    return knn.recall(vectors, knn.nearest(vectors))


def _near_revisions(spark: SparkSession, sf_dir: str) -> near_duplicates.NearDuplicates:
    return near_duplicates.NearDuplicates(read(spark, sf_dir, "memory_revisions"), "id", "searchable_text", Fraction(7, 10), 3)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of revisions whose texts are nearly the same."""
    return _near_revisions(spark, sf_dir).text_pairs().withColumnsRenamed({"id_a": "revision_id_a", "id_b": "revision_id_b"})


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revision with a near copy, its group and its class's number of links."""
    return _near_revisions(spark, sf_dir).groups().withColumnRenamed("id", "revision_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they leak."""
    return leaks.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked item with the number of its documents."""
    found = p7_found(spark, sf_dir)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_doc_id"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents with the leaked passages cut out; text is null where a document is dropped."""
    return leaks.remove_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mix and how often each is used."""
    return mixture.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mixture_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixture.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mixture_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation.judge(read(spark, sf_dir, "documents")).filter("truncated").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts."""
    return truncation.rates(truncation.judge(read(spark, sf_dir, "documents")))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p4_found": p4_found,
    "p4_recall": p4_recall,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p7_cleaned": p7_cleaned,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}

#: NFKC of the full-width forms, by rule; composed letters come from NFC.
_WIDE, _NARROW = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_NORMAL = f"regexp_extract_all(lower(translate(nfc_normalize(text), '{_WIDE}', '{_NARROW}')), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "unnest(list_transform(range(1, (len(w) - n + 2)::BIGINT), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS g"
_LEAKS = f"""
WITH i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT DISTINCT item_id, {_NORMAL} AS w FROM eval_items) WHERE len(w) > 0), ig AS (SELECT item_id, n, {_GRAMS} FROM i),
d AS (SELECT doc_id, w, n FROM (SELECT DISTINCT doc_id, {_NORMAL} AS w FROM documents WHERE text IS NOT NULL), (SELECT DISTINCT n FROM i) WHERE len(w) >= n), dg AS (SELECT doc_id, n, {_GRAMS} FROM d),
leaks AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g))"""

SQL = {
    "p1_found": """
SELECT DISTINCT r.id AS revision_id, l.field AS field FROM memory_revisions r JOIN split_limits l
ON (l.field = 'content_json' AND length(r.content_json) > l.max_chars)
OR (l.field = 'searchable_text' AND length(r.searchable_text) > l.max_chars)""",
    "p5_found": """
WITH w AS (SELECT DISTINCT id, regexp_extract_all(lower(searchable_text), '[\\p{L}\\p{N}]+') AS w FROM memory_revisions WHERE id IS NOT NULL AND searchable_text IS NOT NULL),
g AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
s AS (SELECT id, len(g) AS n, unnest(g) AS h FROM g),
o AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.id < b.id WHERE 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY ALL)
SELECT a AS revision_id_a, b AS revision_id_b FROM o WHERE 10 * o >= 7 * (na + nb - o)""",
    "p7_found": f"{_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p7_items": f"{_LEAKS} SELECT item_id, count(*) AS n_documents, min(doc_id) AS first_doc_id FROM leaks GROUP BY item_id",
}
