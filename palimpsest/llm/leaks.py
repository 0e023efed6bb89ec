"""Evaluation passages inside training text.

The normalised n-grams of the held-out items are broadcast as a hash set of checked size; every
document's word windows are scanned against it, a batch of documents at a time, and hits are
verified word for word. Items beyond the size are scanned in further passes, so none is left out.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest.functions.bloom import might_contain
from palimpsest.llm.words import normal_words, word_spans
from palimpsest.session import materialize

N = 13

#: Words of items in one broadcast; more items take more passes over the documents.
MAX_WORDS = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)

HITS = "doc_id bigint, item_id bigint, n_windows int, first_word int, last_word int"
SPANS = "doc_id bigint, low int, high int"
CLEAN = "doc_id bigint, n_spans int, removed_chars int, text string"


class Grams:
    """The n-grams of the items (items of fewer words as one gram), hashed by length."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.owners: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in normal_words(text or "")]
            size = min(n, len(ids))
            if size:
                for gram in {tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)}:
                    self.owners[gram].append(item)
        self.hashes = {}
        for size in {len(g) for g in self.owners}:
            grams = np.array([g for g in self.owners if len(g) == size], dtype=np.uint64)
            self.hashes[size] = np.unique(self._roll(grams.T))

    @staticmethod
    def _roll(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for column in columns:
            h = h * _BASE + column
        return h

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(document number, first word, number of words, item) of every verified window."""
        ids, starts = [], []
        get = self.vocabulary.get
        for text in texts:
            starts.append(len(ids))
            ids.extend([get(w, 0) for w in normal_words(text or "")])
            ids.append(0)  # no window reaches into the next document
        word = np.array(ids, dtype=np.uint64)
        total = len(word)
        if not total or not self.hashes:
            return
        # Words from each position up to the next unknown one.
        unknown = np.flatnonzero(word == 0)
        run = unknown[np.searchsorted(unknown, np.arange(total))] - np.arange(total)
        first = np.array(starts)
        h = np.zeros(total, dtype=np.uint64)
        for size in range(1, max(self.hashes) + 1):
            if total < size:
                break
            h = h[: total - size + 1] * _BASE + word[size - 1 :]
            known = self.hashes.get(size)
            if known is None:
                continue
            candidates = np.flatnonzero(run[: len(h)] >= size)
            for at in candidates[np.isin(h[candidates], known)].tolist():
                items = self.owners.get(tuple(ids[at : at + size]))
                if items:
                    doc = int(np.searchsorted(first, at, side="right")) - 1
                    for item in items:
                        yield doc, at - starts[doc], size, item


def _passes(items: DataFrame, n: int, max_words: int) -> Iterator[Grams]:
    """Grams of all items, as many items at a time as the broadcast may hold."""
    words = F.size(F.split(F.col("text"), r"[^\p{L}\p{N}]+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    parts = max(1, math.ceil(total / max_words))
    for part in range(parts):
        chosen = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        yield Grams([(r[0], r[1]) for r in chosen.toLocalIterator()], n)


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).dropDuplicates(["item_id"]).filter(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()
    )


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).filter(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )


def find_leaks(documents: DataFrame, items: DataFrame, n: int = N, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word) of every document that holds ``n``
    consecutive words of an item, or all words of an item that has fewer.

    Null texts and ids, and items without words, match nothing; redelivered documents and items
    count once; other columns are not read.
    """
    docs = _documents(documents)
    target = T._parse_datatype_string(HITS)
    found = None
    for grams in _passes(_items(items), n, max_words):
        shared = documents.sparkSession.sparkContext.broadcast(grams)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                spans: dict[tuple[int, int], list[int]] = {}
                for doc, at, size, item in shared.value.scan(batch.column(1).to_pylist()):
                    span = spans.setdefault((ids[doc], item), [0, at, at + size - 1])
                    span[0] += 1
                    span[1], span[2] = min(span[1], at), max(span[2], at + size - 1)
                rows = [(*k, *v) for k, v in spans.items()]
                yield pa.RecordBatch.from_pylist([dict(zip(target.names, r)) for r in rows], schema=_arrow(target))

        part = docs.mapInArrow(run, target)
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["doc_id", "item_id"])


def leaked_spans(documents: DataFrame, items: DataFrame, n: int = N, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, low, high): word ranges of the verified windows, merged within a document and pass.

    Every pass scans with a broadcast of its own, so that no task holds more than one.
    """
    docs = _documents(documents)
    target = T._parse_datatype_string(SPANS)
    found = None
    for grams in _passes(_items(items), n, max_words):
        shared = documents.sparkSession.sparkContext.broadcast(grams)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                spans = defaultdict(list)
                for doc, at, size, _ in shared.value.scan(batch.column(1).to_pylist()):
                    spans[doc].append((at, at + size))
                rows = [(ids[doc], low, high) for doc, own in spans.items() for low, high in merged(own)]
                yield pa.RecordBatch.from_pylist([dict(zip(target.names, r)) for r in rows], schema=_arrow(target))

        part = docs.mapInArrow(run, target)
        found = part if found is None else found.unionByName(part)
    return found


def remove_leaks(documents: DataFrame, items: DataFrame, n: int = N, max_words: int = MAX_WORDS) -> DataFrame:
    """Leaking documents with the leaked spans cut out: (doc_id, n_spans, removed_chars, text).

    Text is null, to drop the document, where offsets cannot be told after normalisation or where
    no word is left. Documents without leaks are not repeated here: they stay as they are.
    """
    spans = materialize(leaked_spans(documents, items, n, max_words), "spans")
    # A document has at most as many spans as words.
    spans = spans.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    leaking = might_contain(spans, "doc_id", "doc_id", max(1, spans.count()))
    hit = _documents(documents).filter(leaking).dropDuplicates(["doc_id"]).join(spans, "doc_id")
    target = T._parse_datatype_string(CLEAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *cut_spans(text, [(x["low"], x["high"]) for x in own])) for doc, text, own in zip(*[batch.column(i).to_pylist() for i in range(3)])]
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, r)) for r in rows], schema=_arrow(target))

    return hit.select("doc_id", "text", "spans").mapInArrow(run, target)


def merged(found: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for low, high in sorted(found):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def cut_spans(text: str, found: list[tuple[int, int]]) -> tuple[int, int, str | None]:
    """(spans, characters removed, text without the word ranges ``found`` or None)."""
    ranges = merged(found)
    words = word_spans(text)
    if words is None:
        return len(ranges), len(text), None
    kept, at = [], 0
    for low, high in ranges:
        kept.append(text[at : words[low][1]])
        at = words[high - 1][2]
    rest = "".join(kept) + text[at:]
    if not normal_words(rest):
        return len(ranges), len(text), None
    return len(ranges), len(text) - len(rest), rest


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])
