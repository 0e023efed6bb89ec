"""Keyset pages and their opaque cursors."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from palimpsest.operators.filters import keyset_after


def fingerprint(filters: dict) -> str:
    """A cursor belongs to the filters it was made with."""
    return hashlib.sha256(json.dumps(filters, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def encode(values: list, filters: dict | None = None) -> str:
    body = {"v": values, "f": fingerprint(filters) if filters is not None else None}
    return base64.urlsafe_b64encode(json.dumps(body, default=str).encode()).rstrip(b"=").decode()


def decode(cursor: str, filters: dict | None = None) -> list:
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        values, made_with = body["v"], body["f"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if filters is not None and made_with != fingerprint(filters):
        raise ValueError("the cursor belongs to other filters")
    return values


def page(df: DataFrame, keys: list[tuple[str, bool]], size: int, after: list | None = None) -> DataFrame:
    """Up to ``size + 1`` rows in key order after the cursor row; the extra row says that more follow."""
    if after is not None:
        df = df.filter(keyset_after(keys, after))
    return df.orderBy(*[F.asc(k) if up else F.desc(k) for k, up in keys]).limit(size + 1)
