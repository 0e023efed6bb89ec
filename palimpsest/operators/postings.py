"""An inverted index: which records hold a term, in which column and where.

Built once, when records arrive, and written sorted by term: a search reads the row groups of its own
terms and the one row of corpus statistics, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.functions import text
from palimpsest.operators.lexical import B, K1, LEAST_IDF, query_phrases
from palimpsest.session import materialize


@dataclass(frozen=True)
class Index:
    """``postings`` (term, id, field, size, at): the positions of a term in one column of a record
    and how many tokens the record has in all columns, repeats of redelivered records included;
    ``statistics``: (rows, mean) of all records."""

    postings: DataFrame
    statistics: DataFrame


POSTINGS = "term string, id string, field int, size int, at array<int>"
#: Partitions that the records of one term spread over, however many they are.
SALT = 16


def build(corpus: DataFrame, columns: list[str], id_column: str = "id") -> Index:
    """The index of ``columns``; a field is a column's place among them. Redelivered records (same id)
    count once, rows with a null id leave, null texts have no tokens.

    A batch of records is turned over at once: its tokens are numbered, and sorting the pairs of
    record and number brings the positions of each posting together. Every record also has a row
    of the empty term, which holds its size.
    """
    narrow = corpus.select(F.col(id_column).cast("string").alias("id"), *[text.tokens(c).alias(f"t{i}") for i, c in enumerate(columns)]).filter("id IS NOT NULL")
    target = T._parse_datatype_string(POSTINGS)

    def rows(terms: pa.Array, ids: pa.Array, field: int, size: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at, pa.int32()))
        return pa.RecordBatch.from_arrays([terms, ids, pa.array(np.full(len(terms), field), pa.int32()), pa.array(size, pa.int32()), lists], names=target.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0).cast(pa.string()), batch.num_rows
            lengths = [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]]
            size = sum(lengths)
            yield rows(pa.array([""] * n, pa.string()), ids, 0, size, np.zeros(n + 1), np.empty(0))
            for field, length in enumerate(lengths):
                words = batch.column(field + 1).flatten().cast(pa.string()).dictionary_encode()
                if not len(words):
                    continue
                record = np.repeat(np.arange(n), length)
                place = np.arange(len(words)) - np.repeat(np.cumsum(length) - length, length)
                key = record * len(words.dictionary) + words.indices.to_numpy().astype(np.int64)
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                own = record[order[first]]
                terms = words.dictionary.take(words.indices.take(pa.array(order[first])))
                yield rows(terms, ids.take(pa.array(own)), field, size[own], np.append(first, len(key)), place[order])

    spread = narrow.mapInArrow(run, target).repartition("term", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    written = materialize(spread.sortWithinPartitions("term", "id"), "postings")
    counted = written.filter("term = ''").select("id", "size").dropDuplicates(["id"])
    return Index(written, materialize(counted.agg(F.count(F.lit(1)).alias("rows"), F.avg("size").alias("mean")), "statistics"))


def exists(index: Index) -> bool:
    """Whether the index's files are still there."""
    try:
        index.postings.limit(1).count()
        return index.statistics.first() is not None
    except Exception:  # noqa: BLE001 - files that cannot be read are gone
        return False


def _phrase(words: list[str], number: dict[str, int]) -> Column:
    """How often the words follow each other in one column."""
    begins = lambda word, step: F.transform(F.col(f"_p{number[word]}"), lambda x: x - step)
    at = F.col(f"_p{number[words[0]]}")
    for step, word in enumerate(words[1:], 1):
        at = F.array_intersect(at, begins(word, step))
    return F.size(at)


def search(index: Index, weights: list[float], query: str) -> DataFrame:
    """(id, score) of the records that hold a phrase of the query, by BM25 over weighted columns with
    the statistics of all records; higher is better. A query without tokens finds nothing."""
    phrases = query_phrases(query)
    if not phrases:
        return index.postings.limit(0).select("id", F.lit(0.0).alias("score"))
    number = {w: i for i, w in enumerate(dict.fromkeys(w for p in phrases for w in p))}
    found = index.postings.filter(F.col("term").isin(list(number)))
    none = F.array().cast("array<int>")
    by_field = found.groupBy("id", "size", "field").agg(*[F.coalesce(F.max(F.when(F.col("term") == w, F.col("at"))), none).alias(f"_p{i}") for w, i in number.items()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("field") + 1)
    hits = by_field.groupBy("id", "size").agg(*[F.sum(_phrase(p, number) * weight).alias(f"_h{i}") for i, p in enumerate(phrases)])
    # Two rows reach the driver: the statistics, and how many records hold each phrase.
    corpus = index.statistics.first()
    holds = hits.agg(*[F.count_if(F.col(f"_h{i}") > 0).alias(f"n{i}") for i in range(len(phrases))]).first()
    rows, mean, score = corpus["rows"], corpus["mean"] or 1.0, F.lit(0.0)
    for i in range(len(phrases)):
        ratio = (rows - holds[f"n{i}"] + 0.5) / (holds[f"n{i}"] + 0.5)
        idf = max(math.log(ratio), LEAST_IDF) if ratio > 0 else LEAST_IDF
        tf = F.col(f"_h{i}")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
    return hits.filter(sum((F.col(f"_h{i}") for i in range(1, len(phrases))), F.col("_h0")) > 0).select("id", score.alias("score"))
