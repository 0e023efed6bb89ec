"""BM25 over weighted columns, and exact matches.

A query has few terms, so every row is scored where it lies: the only shuffle is the one-row
statistics of the whole corpus (rows, average length, rows per phrase), taken before any filter.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions import text
from palimpsest.functions.columns import computed_once

# Fixed values of BM25.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def query_phrases(query: str) -> list[list[str]]:
    """Phrases of index tokens for each different term of the query; a hyphenated term is a phrase."""
    import regex

    terms = list(dict.fromkeys(regex.findall(text.TERM, query)))
    return [p for t in terms if (p := regex.findall(text.TOKEN, text.fold_text(t)))]


def _hits(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens follow each other."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    starts = F.when(F.size(tokens) >= len(phrase), F.sequence(F.lit(0), F.size(tokens) - len(phrase))).otherwise(F.array().cast("array<int>"))

    def begins(i: Column) -> Column:
        same = tokens[i] == phrase[0]
        for j, word in enumerate(phrase[1:], 1):
            same = same & (tokens[i + j] == word)
        return same

    return F.size(F.filter(starts, begins))


def _counts(phrases: list[list[str]]):
    """Token count and hits per phrase of one text. The tokens are a lambda variable, so that they
    are found once per text and not once per use."""
    return lambda t: F.struct(F.size(t).alias("n"), *[_hits(t, phrase).alias(f"h{p}") for p, phrase in enumerate(phrases)])


def bm25(corpus: DataFrame, columns: dict[str, float], query: str) -> DataFrame:
    """``corpus`` rows that hit, with ``score`` (higher is better). ``columns`` maps text columns to
    weights. Statistics are those of all of ``corpus``, so filter the result, not the input."""
    phrases = query_phrases(query)
    if not phrases:
        return corpus.withColumn("score", F.lit(0.0)).limit(0)
    weights = list(columns.values())
    counted = computed_once(corpus, {f"_c{i}": F.transform(F.array(text.tokens(c)), _counts(phrases))[0] for i, c in enumerate(columns)})
    flat = {"_len": sum((F.col(f"_c{i}.n") for i in range(1, len(weights))), F.col("_c0.n"))}
    for p in range(len(phrases)):
        for i in range(len(weights)):
            flat[f"_h{p}_{i}"] = F.col(f"_c{i}.h{p}")
    counted = counted.withColumns(flat).drop(*[f"_c{i}" for i in range(len(weights))])
    hits = [name for name in flat if name != "_len"]
    any_hit = [sum((F.col(f"_h{p}_{i}") for i in range(1, len(weights))), F.col(f"_h{p}_0")) > 0 for p in range(len(phrases))]
    stats = counted.agg(F.count(F.lit(1)).alias("rows"), F.avg("_len").alias("mean"), *[F.count_if(h).alias(f"n{p}") for p, h in enumerate(any_hit)]).first()
    rows, mean = stats["rows"], stats["mean"] or 1.0
    score: Column = F.lit(0.0)
    for p in range(len(phrases)):
        n = stats[f"n{p}"]
        ratio = (rows - n + 0.5) / (n + 0.5)
        idf = max(math.log(ratio), LEAST_IDF) if ratio > 0 else LEAST_IDF
        tf = sum((F.col(f"_h{p}_{i}") * w for i, w in enumerate(weights)), F.lit(0.0))
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(mean)))
    hit = any_hit[0]
    for h in any_hit[1:]:
        hit = hit | h
    drop = ["_len", *hits]
    return counted.filter(hit).withColumn("score", score).drop(*drop)


def top(df: DataFrame, k: int, id_column: str) -> DataFrame:
    return df.orderBy(F.desc("score"), id_column).limit(k)


def exact(heads: DataFrame, memories: DataFrame, query: str, k: int) -> DataFrame:
    """(id, memory_id, recorded_at, rank_value): revisions matched by logical key (0), memory or
    revision id (1) or title (2), each with its best rank."""
    from palimpsest.operators.filters import literal, nocase_equal

    q = literal(query)
    keyed = memories.filter(F.col("logical_key") == q).select(F.col("id").alias("memory_id")).distinct()
    branches = (
        heads.join(keyed, "memory_id", "left_semi").select("id", "memory_id", "recorded_at", F.lit(0).alias("rank_value"))
        .unionByName(heads.filter((F.col("memory_id") == q) | (F.col("id") == q)).select("id", "memory_id", "recorded_at", F.lit(1).alias("rank_value")))
        .unionByName(heads.filter(nocase_equal("title", q)).select("id", "memory_id", "recorded_at", F.lit(2).alias("rank_value")))
    )
    best = branches.groupBy("id", "memory_id", "recorded_at").agg(F.min("rank_value").alias("rank_value"))
    return best.orderBy("rank_value", F.desc("recorded_at"), "id").limit(k)


def prefix_terms(query: str) -> list[str]:
    """Folded terms of a prefix query, all of which must begin some token."""
    return [text.fold_text(t) for t in re.findall(r"\w+", query)]


def _begins(term: str):
    return lambda x: x.startswith(term)


def all_prefixes(tokens: str | Column, terms: list[str]) -> Column:
    keep = F.lit(bool(terms))
    for t in terms:
        keep = keep & F.exists(tokens, _begins(t))
    return keep
