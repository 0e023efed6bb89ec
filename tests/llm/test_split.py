from __future__ import annotations

import json

import pytest
from hypothesis import given, settings, strategies as st

from palimpsest.llm import split


def check(text, limit, overlap):
    pieces = split.cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(e - s <= limit for s, e, _ in pieces)
    for (_, e, _), (s, e2, _) in zip(pieces, pieces[1:]):
        assert s == e - overlap and e2 > e
    rest = "".join(text[s + (overlap if i else 0) : e] for i, (s, e, _) in enumerate(pieces))
    assert rest == text
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab ,.\n。"{}[]:\\é́🙂', max_size=400), st.integers(1, 60), st.data())
def test_pieces_are_the_text(text, limit, data):
    check(text, limit, data.draw(st.integers(0, limit - 1)))


def test_breaks_are_preferred_in_order():
    text = "First paragraph here.\n\nSecond one. It goes on and on"
    assert [text[s:e] for s, e, _ in check(text, 30, 0)] == ["First paragraph here.\n\n", "Second one. It goes on and on"]
    assert [k for *_, k in check("one two three four five six", 12, 0)][:-1] == ["word", "word"]
    assert [k for *_, k in check("x" * 50, 20, 5)] == ["hard", "hard", "end"]
    assert [k for *_, k in check("これは文です。" * 10, 20, 0)][0] == "sentence"


def test_records_break_between_members():
    text = json.dumps({f"key{i}": "some words, and more; here" for i in range(20)})
    for s, e, kind in check(text, 120, 10)[:-1]:
        assert kind == "member" and text[e - 1] == ","
    broken = text[:-1]
    assert {k for *_, k in check(broken, 120, 10)} <= {"word", "sentence", "end"}


def test_hard_cuts_keep_marks_with_their_letter():
    text = "é" * 100
    for _, e, _ in check(text, 21, 0)[:-1]:
        assert text[e] == "e"


def test_limits_must_make_sense():
    with pytest.raises(ValueError):
        split.cut("abc", 2, 2)


def test_operator(spark):
    rows = [("a", "x" * 30, "y" * 5, 1, "c"), ("a", "x" * 30, "y" * 5, 1, "c"), ("b", None, "🙂" * 11, 1, "c"), (None, "x" * 30, None, 1, "c"), ("d", "", "z" * 10, 1, "c")]
    df = spark.createDataFrame(rows, "id string, f string, g string, piece int, record_id string")
    out = split.split_oversized(df, "id", {"f": (20, 4), "g": (10, 2)})
    assert sorted((r.record_id, r.field, r.piece, len(r.text)) for r in out.collect()) == [("a", "f", 0, 20), ("a", "f", 1, 14), ("b", "g", 0, 10), ("b", "g", 1, 3)]
    assert split.split_oversized(df.limit(0), "id", {"f": (20, 4)}).count() == 0


def test_very_long_text():
    text = "word. " * 200_000
    assert len(check(text, 3200, 160)) > 300
