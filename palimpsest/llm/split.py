"""Splitting oversized texts and records at natural boundaries.

Character classes of a whole value are found at once; token ends are prefix sums of token lengths,
and each kind of break is a sorted array of such ends. A piece ends at the last break that a binary
search finds under the limit, the next piece starts the overlap before that end.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest.functions.json_index import parse

SCHEMA = "record_id string, field string, piece int, start_char int, end_char int, break_kind string, text string"

#: A stronger break is taken only if it fills this share of the limit; else a weaker one is tried.
FILL = 0.5

_SPACES = np.array([ord(c) for c in " \t\n\r\v\f   　"], dtype=np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…"], dtype=np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in "。！？｡"], dtype=np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]}»”’」』"], dtype=np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _token_ends(kind: np.ndarray) -> np.ndarray:
    """End offsets of the maximal runs of one class: the prefix sums of the token lengths."""
    starts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(kind)])))
    return np.cumsum(lengths)


def _text_breaks(c: np.ndarray) -> list[tuple[str, np.ndarray]]:
    space = np.isin(c, _SPACES)
    ends = _token_ends(space)
    after_space = ends[space[ends - 1]]
    newlines = np.concatenate(([0], np.cumsum(c == 0x0A)))
    run_starts = np.concatenate(([0], ends[:-1]))[space[ends - 1]]
    in_run = newlines[after_space] - newlines[run_starts]
    # The character that closes the text before a run of spaces, past quotes and brackets.
    closer = np.isin(c, _CLOSERS)
    last_plain = np.maximum.accumulate(np.where(closer, -1, np.arange(len(c))))
    before = np.where(run_starts > 0, last_plain[np.maximum(run_starts - 1, 0)], -1)
    stop = (before >= 0) & np.isin(c[np.maximum(before, 0)], _STOPS)
    wide = np.flatnonzero(np.isin(c, _WIDE_STOPS)) + 1
    return [
        ("paragraph", after_space[in_run >= 2]),
        ("line", after_space[in_run >= 1]),
        ("sentence", np.union1d(after_space[stop], wide)),
        ("word", after_space),
    ]


def _record_breaks(c: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Breaks of a JSON text: after members of the outermost level, after any element."""
    at = np.arange(len(c))
    quote, backslash = c == 0x22, c == 0x5C
    if backslash.any():
        last_other = np.maximum.accumulate(np.where(backslash, -1, at))
        q = np.flatnonzero(quote)
        run = np.where(q > 0, q - 1 - last_other[np.maximum(q - 1, 0)], 0)
        quote = quote.copy()
        quote[q[(run & 1) == 1]] = False
    outside = (np.cumsum(quote) & 1) == 0
    opens = ((c == 0x7B) | (c == 0x5B)) & outside
    closes = ((c == 0x7D) | (c == 0x5D)) & outside
    depth = np.cumsum(opens.astype(np.int32) - closes.astype(np.int32))
    comma = (c == 0x2C) & outside
    return [("member", np.flatnonzero(comma & (depth == 1)) + 1), ("element", np.flatnonzero(comma) + 1)]


def break_arrays(text: str) -> list[tuple[str, np.ndarray]]:
    """(kind, sorted end offsets) of every kind of break, strongest first."""
    c = _points(text)
    if text[:1] in ("{", "[") or text.lstrip(" \t\r\n")[:1] in ("{", "["):
        if parse(text)[0]:
            return [*_record_breaks(c), *[b for b in _text_breaks(c) if b[0] in ("sentence", "word")]]
    return _text_breaks(c)


def _hard_end(text: str, start: int, end: int) -> int:
    """Steps a cut without a break back so that it does not part a letter from its marks."""
    for back in range(16):
        at = end - back
        if at <= start + 1:
            break
        c = text[at]
        if not (unicodedata.combining(c) or c in "‍︎️" or text[at - 1] == "‍"):
            return at
    return end


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of break at the end) of the pieces of ``text``, in code points.

    No piece is longer than ``limit``, neighbours share exactly ``overlap`` characters, and the
    pieces without their overlaps are the text. A text within the limit is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    size = len(text)
    if size <= limit:
        return [(0, size, "end")]
    arrays = break_arrays(text)
    pieces, start = [], 0
    while size - start > limit:
        last = start + limit
        floor = start + overlap  # an end must lie beyond, or the next piece would not advance
        end, kind = 0, "hard"
        for least in (max(floor, start + int(limit * FILL)), floor):
            for name, ends in arrays:
                i = int(np.searchsorted(ends, last, side="right")) - 1
                if i >= 0 and ends[i] > least:
                    end, kind = int(ends[i]), name
                    break
            if end:
                break
        if not end:
            end = max(_hard_end(text, floor, last), floor + 1)
        pieces.append((start, end, kind))
        start = end - overlap
    pieces.append((start, size, "end"))
    return pieces


def split_oversized(df: DataFrame, id_column: str, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Pieces of every value of the fields in ``limits`` (field -> max_chars, overlap_chars) that
    is longer than its limit, counted in code points.

    Gives (record_id, field, piece from 0, start_char, end_char, break_kind, text). Null and short
    values give no rows; rows with a null id have nothing to link to and give none; redelivered
    rows (same id) count once. Other columns are not read, whatever their names.
    """
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(n).alias("size")) for f, (n, _) in limits.items()])
    oversized = (
        df.filter(F.col(id_column).isNotNull())
        .select(F.col(id_column).alias("record_id"), F.inline(values))
        .filter(F.length("value") > F.col("size"))
        .select("record_id", "field", "value")
        .dropDuplicates(["record_id", "field"])
    )
    target = T._parse_datatype_string(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record, field, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                limit, overlap = limits[field]
                found = cut(text, limit, overlap)
                for low in range(0, len(found), 2000):
                    part = found[low : low + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([record] * len(part), pa.string()),
                            pa.array([field] * len(part), pa.string()),
                            pa.array(range(low, low + len(part)), pa.int32()),
                            pa.array([s for s, _, _ in part], pa.int32()),
                            pa.array([e for _, e, _ in part], pa.int32()),
                            pa.array([k for *_, k in part], pa.string()),
                            pa.array([text[s:e] for s, e, _ in part], pa.string()),
                        ],
                        names=target.names,
                    )

    return oversized.mapInArrow(run, target)
