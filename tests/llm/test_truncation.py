from __future__ import annotations

import pytest
from conftest import TINY

from palimpsest.llm import queries, truncation as X

WHOLE = [
    "", " ", "-", "A complete sentence here.", "Asked twice, was it so?", "Done! ✅", "They called it \"good enough.\"", "We shall see (and so on ...).", "この文は終わっている。", "One. Two. (see urn:sheet:AB-1234)",
    "Text before.\n* * *", "Text before.\n```\nstatus: ok\n```", "Text before.\n| A | 12 |", "Text before.\n- spare keys: 15 counted", "Text before.\n\n[desk, sheet AB-12]", "Text before.\n\n-- \nSent by the relay",
    "Text before.\n---\nDesk AB-12. Do not reply.", '{"a": ["b."], "c": null}', '{"q": "x"}\n\nProse that ends.', "Desk: Ilros\nTopic: Ildra\nBasis: the old list", "Items\n- one: 25 AB-44904\n- two: 41 AB-12999", "$/statement: It was done. So it was.\n$/place: Marros", "Text, etc. »",
]
CUT = [
    "It was agreed that the thi", "It was agreed, and", "It was agreed to do th…", "It was agreed...", "It was agreed to [truncated]", "The wor-", "A sentence. The value was 12\\u00", "Broken char�", "Mills: 12 EUR. Acme Supply: 142.",
    "It was agreed that the\n\n[desk, sheet AB-12]", "It was agreed that the\n\n-- \nSent by the relay", "It was agreed that\n---\nDesk AB-12. Do not reply.", '{"a": ["b."], "c": nu', '{"a": "It was done.', "Text.\n```\nstatus: ok", "Text.\n| A | 1",
    "Items\n- one: 25 AB-44904\n- two: 41 AB-12999\n- thr", "Desk: Ilros\nTopic: Ildra\nBas", "これは途中で切れ",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert not X.ending(text).startswith("cut"), X.ending(text)


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert X.ending(text).startswith("cut"), X.ending(text)


DOCS = "doc_id long, text string, source string, core int, ending string"


def judged(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], DOCS)
    return {r.doc_id: r for r in X.judge(df, **kw).collect()}


def test_prefix_of_a_longer_copy(spark):
    items = "Stock\n" + "\n".join(f"- item number {i}: {i} AB-{10000 + i}" for i in range(8))
    rows = [(1, items, "s"), (2, items[:-3], "s"), (3, items[:-3], "s"), (4, "- " * 4, None), (5, None, "s"), (None, "x", "s")]
    got = judged(spark, rows)
    assert not got[1].truncated and got[2].is_prefix and got[2].truncated and got[3].truncated and set(got) == {1, 2, 3, 4}


@pytest.mark.parametrize("hot", [1, 100_000])
def test_prefixes_with_hot_groups(spark, hot):
    base = "shared beginning of every text in this group " * 30
    texts = [base[:n] + tail for n, tail in ((100, ""), (100, "one"), (700, ""), (700, "zzz"), (701, "xy"), (900, ""), (300, "q"))]
    df = spark.createDataFrame([(t.strip(),) for t in texts], "core string")
    want = {t.strip() for t in texts if any(o.strip() != t.strip() and o.strip().startswith(t.strip()) for o in texts)}
    assert {r[0] for r in X.prefixes_of_longer(df, 48, hot).collect()} == want


def test_field_limits(spark):
    rows = [(i, "Items\n" + "- one: 25 AB-44904\n" * 3 + "- x: 1 AB-12" + "3" * (i % 3 + 1), "free") for i in range(30)]
    rows += [(100 + i, ("Desk: Ilros\nTopic: " + "y" * 100)[:60], "capped") for i in range(10)] + [(200 + i, "A short one. " + "z" * i + ".", "capped") for i in range(20)]
    got = judged(spark, rows)
    assert all(got[100 + i].at_limit and got[100 + i].truncated for i in range(10)) and not any(got[200 + i].truncated for i in range(20))


def test_empty_and_rates(spark):
    assert judged(spark, []) == {}
    rates = {r.source: r for r in queries.p9_rates(spark, TINY).collect()}
    assert sum(r.n_truncated for r in rates.values()) == queries.p9_found(spark, TINY).count()


@pytest.mark.parametrize("text", ['[{"t":"It was done.', "[[1, 2, 3, 4], [5, 6, 7, 8]", "[\n[1, 2, 3],\n[4, 5, 6]", '[{"amount": 1}, {"amount": 2},', '["It was done.", tr', '[{"a": "b.\nIt was done.'])
def test_open_arrays_are_cut(text):
    assert X.ending(text) == "cut: open record"


@pytest.mark.parametrize("text", ["[desk, sheet AB-12]", "[1, p. 3] It was done.", "[2024-01-05] It was done.", '["Note"] It was done.', '["Note" of the desk] It was done.', '[{"t":"Done."}]', "[1] It was done."])
def test_bracketed_labels_and_whole_arrays_are_whole(text):
    assert not X.ending(text).startswith("cut"), X.ending(text)


def test_fragments_of_words(spark):
    words = ["Status: open\nOwner: Ann", "Status: open\nOwner: Bo", "It is open. It was opened."] * 2
    rows = [(i, t, "s") for i, t in enumerate(words)] + [(50, "Owner: Ann\nStatus: ope", "s"), (51, "Owner: Bo\nStatus: open", "s"), (52, "Owner: Bo\nStatus: zzz", "s")]
    got = judged(spark, rows)
    assert {i for i, r in got.items() if r.truncated} == {50} and got[50].ending == "cut: word"


def test_short_prefixes_count_within_the_line(spark):
    df = spark.createDataFrame([(t,) for t in ("Desk: Il", "Desk: Ilros and more of it", "Note: one", "Note: one\nPlace: two")], "core string")
    assert {r[0] for r in X.prefixes_of_longer(df).collect()} == {"Desk: Il"}


def test_labels_of_sentences_need_no_number_of_lines(spark):
    rows = [(i, f"Remark: It was done by {w}.\nIt ended.", "s") for i, w in enumerate("abcdefgh")] + [(20, "Desk: Ilros\nRemark: It was", "s"), (21, "Place: here\nDesk: Ilros", "s")]
    assert {i for i, r in judged(spark, rows).items() if r.truncated} == {20}


@pytest.mark.parametrize("text", ["It was…", "It was...", "It was [truncated]", "It was - ", "It was \\u00", "It was�"])
def test_marks_are_not_part_of_a_copy(text):
    assert X.without_marks(text) == "It was"
