"""Text functions on columns: folding, tokens, projections, hashes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

TOKEN = r"[\p{L}\p{N}]+"
TERM = r"[\p{L}\p{N}_-]+"


def accent_pairs(first: int = 0xC0, last: int = 0x24F) -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    marked, plain = [], []
    for code in range(first, last + 1):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]):
            marked.append(chr(code))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = accent_pairs()


def fold(column: str | Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(column), _MARKED, _PLAIN)


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(_MARKED, _PLAIN))


def tokens(column: str | Column) -> Column:
    """Index tokens: folded runs of letters and digits; null gives none."""
    return F.regexp_extract_all(fold(F.coalesce(column, F.lit(""))), F.lit(TOKEN), F.lit(0))


def estimate_tokens(column: str | Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(column) / 4)).cast("int")


def header(title: str, kind: str, tags: str) -> Column:
    """The lines that begin a projection: title, kind, tags, as far as there are any."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), F.col(title)),
        F.concat(F.lit("Kind: "), F.col(kind)),
        F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))),
    )
