"""Structural index of JSON over a whole batch of records at once.

Bitmaps of unescaped quotes, of the text inside strings and of the structural characters outside
strings are built over the concatenated bytes of many records; a prefix sum of the brackets gives
every character's nesting depth, and positions at equal depth give parents, indexes and spans.
"""

from __future__ import annotations

import json
import re

import numpy as np

_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_SPACE = re.compile(r"[ \t\n\r]*")
_TOKEN = re.compile(rf"{_STRING.pattern}|{_NUMBER.pattern}|true|false|null|[{{}}\[\],:]", re.ASCII)


def _no_constant(name: str):
    raise ValueError(name)


def _valid_iterative(text: str) -> bool:
    """RFC 8259 check without recursion, for nesting deeper than the parser's stack."""
    at, stack, want = _SPACE.match(text).end(), [], "value"
    while True:
        c = text[at : at + 1]
        if want == "key" or want == "key or end":
            if c == "}" and want == "key or end":
                stack.pop()
                at += 1
                want = "after"
            else:
                m = _STRING.match(text, at)
                if not m:
                    return False
                at = _SPACE.match(text, m.end()).end()
                if text[at : at + 1] != ":":
                    return False
                at += 1
                want = "value"
        elif want == "after":
            if not stack:
                return at == len(text)
            if c == ",":
                at += 1
                want = "key" if stack[-1] == "{" else "value"
            elif c == ("}" if stack[-1] == "{" else "]"):
                stack.pop()
                at += 1
            else:
                return False
        elif c == "]" and want == "value or end":
            stack.pop()
            at += 1
            want = "after"
        elif c == "{" or c == "[":
            stack.append(c)
            at += 1
            want = "key or end" if c == "{" else "value or end"
        else:
            m = _STRING.match(text, at) if c == '"' else _NUMBER.match(text, at)
            if m:
                at = m.end()
            elif (word := next((w for w in ("true", "false", "null") if text.startswith(w, at)), None)) is not None:
                at += len(word)
            else:
                return False
            want = "after"
        at = _SPACE.match(text, at).end()


def parse(text: str):
    """(is valid RFC 8259 JSON, the value or None where it is nested too deeply to build)."""
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _valid_iterative(text), None
    except json.JSONDecodeError:
        return False, None
    except ValueError:  # a constant, or an integer longer than int() converts
        try:
            return True, json.loads(text, parse_constant=_no_constant, parse_int=float)
        except (ValueError, RecursionError):
            return False, None


def build(text: str):
    """The value of valid JSON that is nested too deeply for the parser."""
    root: list = []
    stack, key, want_key = [root], None, False

    def put(x) -> None:
        if isinstance(stack[-1], dict):
            stack[-1][key] = x
        else:
            stack[-1].append(x)

    for m in _TOKEN.finditer(text):
        token = m.group()
        if token in ("{", "["):
            put(x := {} if token == "{" else [])
            stack.append(x)
            want_key = token == "{"
        elif token in ("}", "]"):
            stack.pop()
        elif token == ",":
            want_key = isinstance(stack[-1], dict)
        elif token == ":":
            want_key = False
        elif want_key:
            key = json.loads(token)
        else:
            put(parse(token)[1])
    return root[0]


def record_text(value: str | None) -> str | None:
    """The record in a stored value: itself, or the object or array that a JSON string encodes.

    None for values without containers and for text that is not valid JSON.
    """
    if not value:
        return None
    head = value.lstrip(" \t\n\r")[:1]
    if head == '"':
        ok, inner = parse(value)
        if not ok or not isinstance(inner, str) or inner.lstrip(" \t\n\r")[:1] not in ("{", "["):
            return None
        return inner if parse(inner)[0] else None
    if head not in ("{", "["):
        return None
    return value if parse(value)[0] else None


def _clean(text: str) -> str:
    """Lone surrogates cannot be stored as UTF-8; they become U+FFFD."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def step(key: str) -> str:
    """A key as a step of a path."""
    return key.replace("~", "~0").replace("/", "~1")


def _key(raw: bytes) -> str:
    text = raw.decode("utf-8", "surrogatepass")
    if "\\" in text:
        text = json.loads(f'"{text}"')
    return step(text)


def array_objects(records: list[str]) -> list[tuple[int, str, str, int, str]]:
    """Objects that are direct array elements, in every valid record.

    Gives (record number, path, path of the nearest enclosing such object or ``$``, index in the
    array, the object's text), in document order.
    """
    if not records:
        return []
    blobs = [r.encode("utf-8", "surrogatepass") for r in records]
    buf = np.frombuffer(b"\n".join(blobs), dtype=np.uint8)
    ends = np.cumsum([len(b) + 1 for b in blobs])
    at = np.arange(len(buf))

    # Quote bitmap: a quote after an odd run of backslashes is escaped.
    quote = buf == 0x22
    backslash = buf == 0x5C
    if backslash.any():
        last_other = np.maximum.accumulate(np.where(backslash, -1, at))
        q = np.flatnonzero(quote)
        run = np.where(q > 0, q - 1 - last_other[np.maximum(q - 1, 0)], 0)
        quote[q[(run & 1) == 1]] = False
    inside = (np.cumsum(quote, dtype=np.int32) & 1).astype(bool)

    # Bracket and delimiter bitmaps outside strings; depth by prefix sum.
    opens = ((buf == 0x7B) | (buf == 0x5B)) & ~inside
    closes = ((buf == 0x7D) | (buf == 0x5D)) & ~inside
    marks = np.flatnonzero((opens | closes | (((buf == 0x2C) | (buf == 0x3A)) & ~inside)))
    if not len(marks):
        return []
    char = buf[marks]
    is_open, is_close = opens[marks], closes[marks]
    depth = np.cumsum(is_open.astype(np.int32) - is_close.astype(np.int32))

    node_at = marks[is_open]
    node_depth = depth[is_open]
    node_object = char[is_open] == 0x7B
    count = len(node_at)
    parent = np.full(count, -1, dtype=np.int64)
    index = np.zeros(count, dtype=np.int64)
    colon = np.zeros(count, dtype=np.int64)
    stop = np.zeros(count, dtype=np.int64)
    comma_at, comma_depth = marks[char == 0x2C], depth[char == 0x2C]
    colon_at, colon_depth = marks[char == 0x3A], depth[char == 0x3A]
    close_at, close_depth = marks[is_close], depth[is_close] + 1

    # Group positions by depth once; each level then looks only at its own and its parent's.
    def levels(depths: np.ndarray) -> dict[int, np.ndarray]:
        order = np.argsort(depths, kind="stable")
        values, starts = np.unique(depths[order], return_index=True)
        return dict(zip(values.tolist(), np.split(order, starts[1:])))

    nodes, commas, colons, closers = levels(node_depth), levels(comma_depth), levels(colon_depth), levels(close_depth)
    none = np.empty(0, dtype=np.int64)
    for level, own in nodes.items():
        stop[own] = close_at[closers[level]]
        if level == 1:
            continue
        above = nodes[level - 1]
        where = node_at[own]
        up = above[np.searchsorted(node_at[above], where) - 1]
        parent[own] = up
        c = comma_at[commas.get(level - 1, none)]
        index[own] = np.searchsorted(c, where) - np.searchsorted(c, node_at[up])
        k = colon_at[colons.get(level - 1, none)]
        if len(k):
            colon[own] = k[np.maximum(np.searchsorted(k, where) - 1, 0)]

    quotes = np.flatnonzero(quote)
    close_quote = np.searchsorted(quotes, colon) - 1
    record = np.searchsorted(ends, node_at, side="right")
    whole = buf.tobytes()
    parent_list, index_list, object_list = parent.tolist(), index.tolist(), node_object.tolist()
    first_quote = quotes[np.maximum(close_quote - 1, 0)].tolist() if len(quotes) else [0] * count
    last_quote = quotes[np.maximum(close_quote, 0)].tolist() if len(quotes) else [0] * count
    start_list, stop_list, record_list = node_at.tolist(), stop.tolist(), record.tolist()

    paths: list[str] = [""] * count
    holder: list[int] = [-1] * count
    is_row = [False] * count
    found = []
    for i in range(count):
        up = parent_list[i]
        if up < 0:
            paths[i] = "$"
            continue
        if object_list[up]:
            step = _key(whole[first_quote[i] + 1 : last_quote[i]])
        else:
            step = str(index_list[i])
            is_row[i] = object_list[i]
        paths[i] = f"{paths[up]}/{step}"
        holder[i] = up if is_row[up] else holder[up]
        if is_row[i]:
            above = holder[i]
            found.append(
                (record_list[i], _clean(paths[i]), _clean(paths[above]) if above >= 0 else "$", index_list[i], _clean(whole[start_list[i] : stop_list[i] + 1].decode("utf-8", "surrogatepass")))
            )
    return found
