"""The model surface: anything that embeds texts or scores pairs, applied in Arrow batches.

Without weights the stand-ins below serve; a real model only has to offer the same methods."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Texts that a model receives at once, by lane, and characters of a rerank batch.
EMBED_BATCH, RERANK_BATCH, COUNT_BATCH = 8, 4, 64
RERANK_CHARS = 32_000

#: Failures in a row after which a model is left alone, and for how many seconds.
BREAK_AFTER, BREAK_SECONDS = 3, 30.0


def micro_batches(texts: list[str], most: int, chars: int | None = None) -> list[tuple[int, int]]:
    """Ranges of consecutive texts, at most ``most`` each and together within ``chars``, at least one."""
    ends = np.cumsum([0, *[len(t) for t in texts]])
    ranges, low = [], 0
    while low < len(texts):
        fit = int(np.searchsorted(ends, ends[low] + chars, side="right")) - 1 if chars is not None else len(texts)
        high = max(low + 1, min(low + most, fit, len(texts)))
        ranges.append((low, high))
        low = high
    return ranges


def checked(x, rows: int, dim: int) -> np.ndarray:
    """What a model returned as ``rows`` finite vectors of ``dim`` numbers, or an error."""
    x = np.asarray(x, dtype=np.float32)
    if x.shape != (rows, dim) or not np.isfinite(x).all():
        raise ValueError(f"{rows} finite vectors of {dim} expected, shape {x.shape} found")
    return x


class Breaker:
    """Leaves a model alone for a while once it has failed several times in a row."""

    def __init__(self, clock=time.monotonic):
        self.clock, self.failures, self.open_until = clock, 0, 0.0

    def call(self, function, *values):
        if self.clock() < self.open_until:
            raise RuntimeError("the model is left alone after failures")
        try:
            result = function(*values)
        except Exception:
            self.failures += 1
            if self.failures >= BREAK_AFTER:
                self.failures, self.open_until = 0, self.clock() + BREAK_SECONDS
            raise
        self.failures = 0
        return result


@dataclass(frozen=True)
class Profile:
    """What a vector depends on; vectors of different profiles are never compared."""

    model: str
    revision: str
    dim: int
    instruction: str = ""

    @property
    def id(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def with_instruction(instruction: str, query: str) -> str:
    """A query as models with instructions expect it; documents have none."""
    return f"Instruct: {instruction}\nQuery: {query}" if instruction else query


class HashingEmbedder:
    """Deterministic unit vectors from hashed words: a stand-in that needs no weights."""

    def __init__(self, dim: int = 64):
        self.profile = Profile("hashing", "1", dim)

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.profile.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest())
                out[i, h % self.profile.dim] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([with_instruction(self.profile.instruction, text)])[0]

    def count_tokens(self, texts: list[str]) -> list[int]:
        return [len(t.split()) for t in texts]


class OverlapReranker:
    """Share of the query's words that a document has: a stand-in for a cross-encoder."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, document in pairs:
            q, d = set(query.lower().split()), set(document.lower().split())
            out.append(len(q & d) / len(q) if q else 0.0)
        return out


EMBEDDED = "segment_id string, model_profile_id string, embedding array<float>, error string"


def embed_each(df: DataFrame, id_column: str, text_column: str, embedder) -> DataFrame:
    """(segment_id, model_profile_id, embedding, error): a vector or the reason why there is none. A
    batch that fails is tried text by text, so that one text costs no other its vector; a null text
    or id gives no row. ``embedder`` may be the model or a function that loads it, once a worker."""
    narrow = df.select(F.col(id_column).alias("segment_id"), F.col(text_column).alias("text")).filter("segment_id IS NOT NULL AND text IS NOT NULL")
    target = T._parse_datatype_string(EMBEDDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder if hasattr(embedder, "embed_documents") else embedder()
        dim, profile, breaker = model.profile.dim, model.profile.id, Breaker()
        ask = lambda texts: checked(breaker.call(model.embed_documents, texts), len(texts), dim)
        for whole in batches:
            texts = whole.column(1).to_pylist()
            found: list = []
            for low, high in micro_batches(texts, EMBED_BATCH):
                try:
                    found.extend((v, None) for v in ask(texts[low:high]))
                except Exception:  # noqa: BLE001 - the text at fault is found one by one
                    for text in texts[low:high]:
                        try:
                            found.append((checked(model.embed_documents([text]), 1, dim)[0], None))
                        except Exception as e:  # noqa: BLE001 - reported with the text
                            found.append((None, str(e)[:500]))
            vectors = pa.array([None if v is None else v.tolist() for v, _ in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array([profile] * len(found), pa.string()), vectors, pa.array([e for _, e in found], pa.string())], names=target.names)

    return narrow.mapInArrow(run, target)


def embed(df: DataFrame, id_column: str, text_column: str, embedder) -> DataFrame:
    """(segment_id, model_profile_id, embedding) of the texts that the model could embed."""
    return embed_each(df, id_column, text_column, embedder).filter("embedding IS NOT NULL").drop("error")


def index_status(segments: DataFrame, embedded: DataFrame) -> DataFrame:
    """(record_id, status, n_segments, error): ``ready`` where every segment (segment_id, record_id)
    has a vector, else ``lexical-only``, with one of the reasons."""
    joined = segments.select("segment_id", "record_id").join(embedded.select("segment_id", F.col("embedding").isNotNull().alias("has"), "error"), "segment_id", "left")
    whole = F.min(F.coalesce("has", F.lit(False)).cast("int"))
    return joined.groupBy("record_id").agg(F.when(whole == 1, "ready").otherwise("lexical-only").alias("status"), F.count(F.lit(1)).alias("n_segments"), F.min("error").alias("error"))


def count_tokens(df: DataFrame, id_column: str, text_column: str, counter) -> DataFrame:
    """(id, n_tokens) by a model's own tokenizer; a null text has none."""
    narrow = df.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    target = T._parse_datatype_string(f"id {kind}, n_tokens int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(1).to_pylist()
            sizes = [n for low, high in micro_batches(texts, COUNT_BATCH) for n in counter.count_tokens(texts[low:high])]
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array(sizes, pa.int32())], names=target.names)

    return narrow.mapInArrow(run, target)


def rerank_scores(df: DataFrame, query: str, reranker, memory: str = "memory_id", text: str = "document") -> DataFrame:
    """(memory_id, reranker) of the few rows that reached the reranker, longest texts together."""
    narrow = df.select(F.col(memory).alias("memory_id"), F.col(text).alias("document")).orderBy(F.desc(F.length("document")))
    target = T._parse_datatype_string("memory_id string, reranker double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [d or "" for d in batch.column(1).to_pylist()]
            scores = [x for low, high in micro_batches(texts, RERANK_BATCH, RERANK_CHARS) for x in reranker.score([(query, d) for d in texts[low:high]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=target.names)

    return narrow.mapInArrow(run, target)


def warm(embedder, reranker) -> dict[str, object]:
    """Loads both models by a probe text each; what they are, or what went wrong."""
    report: dict[str, object] = {"profile": embedder.profile.id}
    for name, ask in (("embedder", lambda: checked([embedder.embed_query("probe")], 1, embedder.profile.dim)), ("reranker", lambda: [float(x) for x in reranker.score([("probe", "probe")])])):
        try:
            ask()
            report[name] = "ready"
        except Exception as e:  # noqa: BLE001 - reported
            report[name] = str(e)
    return report
