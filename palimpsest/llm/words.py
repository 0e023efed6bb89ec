"""Words as the text problems define them: maximal runs of Unicode letters or digits."""

from __future__ import annotations

import re
import unicodedata

WORD = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    """Words after NFKC normalisation and lower-casing."""
    return WORD.findall(unicodedata.normalize("NFKC", text).lower())


def word_spans(text: str) -> list[tuple[str, int, int]] | None:
    """(word, start, end) with offsets into the text as stored.

    None where normalisation mixes characters so that offsets cannot be told.
    """
    parts, offsets = [], []
    start = 0
    for i in range(1, len(text) + 1):
        if i < len(text) and (unicodedata.combining(text[i]) or "ᅠ" <= text[i] <= "ᇿ" or text[i] in "ﾞﾟ"):
            continue
        part = unicodedata.normalize("NFKC", text[start:i]).lower()
        parts.append(part)
        offsets.extend([(start, i)] * len(part))
        start = i
    joined = "".join(parts)
    if joined != unicodedata.normalize("NFKC", text).lower():
        return None
    return [(m.group(), offsets[m.start()][0], offsets[m.end() - 1][1]) for m in WORD.finditer(joined)]
