"""Mixing sources to target shares of the total tokens.

Every document gets a hash-random key. Its high bits are the range it sorts into, so that prefix
sums of the tokens need no task to hold a source: ranges are summed first, their offsets come from
the sums, and rows are only ordered within their range. The cut is where a source's budget ends.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from palimpsest.session import materialize

#: Vocabulary file of a public tokenizer, where the driver finds it.
VOCABULARY = os.environ.get("PALIMPSEST_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")

#: Ranges of the random key per source: rows of one source that a task orders are 1/RANGES of it.
RANGES = 65536

COUNTED = "doc_id bigint, source string, n_tokens bigint"


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens), one row per doc_id; a null text has no tokens."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").alias("source"), F.col("text").alias("text"))
    docs = docs.filter(F.col("doc_id").isNotNull())
    target = T._parse_datatype_string(COUNTED)
    # The driver hands the file to every executor.
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(SparkFiles.get(name))
        tokenizer.encode_special_tokens = True
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes = []
            for low in range(0, len(texts), 256):
                part = [t or "" for t in texts[low : low + 256]]
                sizes.extend(len(e) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=target.names)

    return docs.mapInArrow(run, target).dropDuplicates(["doc_id"])


def _targets(targets: DataFrame) -> DataFrame:
    return (
        targets.filter(F.col("source").isNotNull())
        .groupBy(F.col("source").alias("source"))
        .agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )


def budgets(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget) of every source in either table.

    Without ``total_tokens`` the mix is as large as it can be with every source that has tokens at
    its share: the least of available * max_repeats / target_share. A source without tokens cannot
    contribute and does not hold the others back; one that is not listed has share 0.
    """
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_documents"))
    both = (
        have.withColumnRenamed("source", "s")
        .join(_targets(targets), F.col("s").eqNullSafe(F.col("source")), "full_outer")
        .select(
            F.coalesce("s", "source").alias("source"),
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
            F.coalesce("available", F.lit(0)).alias("available"),
            F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        )
    )
    reach = F.col("available") * F.col("max_repeats")
    if total_tokens is None:
        # One row from per-source sums.
        limit = both.filter((F.col("target_share") > 0) & (reach > 0)).agg(F.min(reach / F.col("target_share"))).first()[0]
        total_tokens = int(limit or 0)
    return both.withColumn("budget", F.least(F.floor(F.col("target_share") * total_tokens), reach).cast("bigint"))


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total_tokens: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: (doc_id, source, n_tokens, times_used), documents used at least once. A source's budget
    takes whole passes over its documents in random order, then the documents whose tokens begin
    before the rest of the budget ends, but for one that would overshoot it by more than it would
    fall short; none is used more than max_repeats times.
    Report: (source, target_share, max_repeats, available_tokens, used_tokens, used_documents,
    actual_share) for every source of either table; unlisted and null sources have target 0.
    """
    counted = materialize(count_tokens(documents, vocabulary), "tokens")
    plan = budgets(counted, targets, total_tokens)
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = counted.filter(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).select(
        "doc_id", "source", "n_tokens", key.alias("key"), F.shiftrightunsigned(key, 64 - (RANGES.bit_length() - 1)).cast("int").alias("range")
    )
    offsets = (
        placed.groupBy("source", "range")
        .agg(F.sum("n_tokens").alias("in_range"))
        .withColumn("offset", F.sum("in_range").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
        .select("source", "range", F.coalesce("offset", F.lit(0)).alias("offset"))
    )
    chosen = plan.filter((F.col("budget") > 0) & F.col("source").isNotNull()).select("source", "max_repeats", "available", "budget")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("running", F.sum("n_tokens").over(within)).join(offsets, ["source", "range"]).join(chosen, "source")
    end = F.col("offset") + F.col("running")
    begin = end - F.col("n_tokens")
    passes = F.floor(F.col("budget") / F.col("available"))
    rest = F.col("budget") - passes * F.col("available")
    extra = ((end <= rest) | ((begin < rest) & (end - rest <= rest - begin))) & (passes < F.col("max_repeats"))
    mixed = summed.select("doc_id", "source", "n_tokens", (passes + extra.cast("int")).cast("int").alias("times_used")).filter("times_used > 0")

    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times_used")).alias("used_tokens"), F.count(F.lit(1)).alias("used_documents")).withColumnRenamed("source", "u")
    whole = Window.partitionBy(F.lit(1))
    report = (
        plan.join(used, F.col("source") == F.col("u"), "left")
        .withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
        .select(
            "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), "used_tokens",
            F.coalesce("used_documents", F.lit(0)).alias("used_documents"),
            F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(whole)), F.lit(0.0)).alias("actual_share"),
        )
    )
    return mixed, report
