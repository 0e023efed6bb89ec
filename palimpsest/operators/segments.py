"""Index segments of a text: pieces packed to a target length, none over a limit.

Pieces and breaks are found once for a whole text; their ends are prefix sums, in which a binary
search finds where a chunk ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Fixed values of the index: characters, then tokens.
TARGET, MOST, PARAGRAPH = 3200, 4800, 4000
MAX_TOKENS = 1200

_BLANK = re.compile(r"\n{2,}")
_SENTENCE = re.compile(r".+?(?:[.!?]+(?=\s|\Z)|\n|\Z)", re.DOTALL)
#: Breaks to cut at, strongest first: lines, sentences, words.
_BREAKS = [re.compile(p) for p in (r"\n+", r"[.!?]+\s+", r"\s+")]


def cut(text: str, limit: int) -> list[str]:
    """Parts of at most ``limit`` characters, each ending at the last of the strongest breaks that
    fill a quarter of the limit, or at the limit itself. No character but white space is lost."""
    ends = [np.array([m.end() for m in p.finditer(text)], dtype=np.int64) for p in _BREAKS]
    bounds = [0]
    while len(text) - bounds[-1] > limit:
        least, last = bounds[-1] + limit // 4, bounds[-1] + limit
        under = [int(e[i - 1]) for e in ends if (i := np.searchsorted(e, last, side="right")) and e[i - 1] > least]
        bounds.append(under[0] if under else last)
    bounds.append(len(text))
    return [part for low, high in zip(bounds, bounds[1:]) if (part := text[low:high].strip())]


def pieces(text: str, most: int = MOST) -> list[str]:
    """Paragraphs; those too long for one as sentences and lines; those over ``most`` as parts."""
    found = []
    for paragraph in _BLANK.split(text):
        paragraph = paragraph.strip()
        parts = [paragraph] if len(paragraph) <= PARAGRAPH else [m.group().strip() for m in _SENTENCE.finditer(paragraph)]
        for part in filter(None, parts):
            found.extend([part] if len(part) <= most else cut(part, most))
    return found


def pack(text: str, target: int = TARGET, most: int = MOST) -> list[str]:
    """Chunks of as many whole pieces as ``target`` characters hold, at least one."""
    if len(text) <= most:
        return [text]
    found = pieces(text, most)
    # Ends of the pieces when all are joined by single spaces.
    ends = np.cumsum([len(p) + 1 for p in found])
    chunks, first = [], 0
    while first < len(found):
        begin = int(ends[first - 1]) if first else 0
        after = max(first + 1, int(np.searchsorted(ends, begin + target + 1, side="right")))
        chunks.append(" ".join(found[first:after]))
        first = after
    return chunks


def estimate(text: str) -> int:
    return max(1, -(-len(text) // 4))


def within_tokens(chunks: list[str], count: Callable[[str], int] = estimate, most: int = MAX_TOKENS) -> list[str]:
    """Chunks cut until none has more than ``most`` tokens: into parts of the length that would
    hold as many if tokens were even, and those again where they are not."""
    done, todo = [], list(reversed(chunks))
    while todo:
        chunk = todo.pop()
        size = count(chunk)
        if size <= most or len(chunk) < 2:
            done.append(chunk)
        else:
            todo.extend(reversed(cut(chunk, max(1, len(chunk) * most // size))))
    return done


def build(df: DataFrame, id_column: str, text_column: str, head_column: str | None = None) -> DataFrame:
    """(segment_id, record_id, ordinal, text, token_count, content_hash); every segment repeats the head."""
    head = F.col(head_column) if head_column else F.lit(None).cast("string")
    narrow = df.select(F.col(id_column).cast("string").alias("record_id"), F.col(text_column).alias("text"), head.alias("head")).filter("record_id IS NOT NULL AND text IS NOT NULL")
    target = T._parse_datatype_string("record_id string, ordinal int, text string, token_count int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ordinals, texts, sizes = [], [], [], []
            for record, text, top in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                for i, chunk in enumerate(within_tokens(pack(text))):
                    whole = f"{top}\n{chunk}" if top else chunk
                    ids.append(record)
                    ordinals.append(i)
                    texts.append(whole)
                    sizes.append(estimate(whole))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ordinals, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], names=target.names)

    return narrow.mapInArrow(run, target).select(
        F.concat_ws(":", "record_id", "ordinal").alias("segment_id"), "record_id", "ordinal", "text", "token_count", F.sha2("text", 256).alias("content_hash")
    )
