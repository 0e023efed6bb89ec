from __future__ import annotations

import duckdb
from conftest import TINY

from palimpsest.llm import leaks, queries
from palimpsest.llm.words import normal_words, word_spans

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id long, text string, doc_id string"
LONG = " ".join(f"word{i}" for i in range(20))


def brute(docs, items, n=13):
    padded = {i: " " + " ".join(normal_words(t)) + " " for i, t in docs if i is not None and t is not None}
    out = set()
    for item, text in items:
        w = normal_words(text or "")
        size = min(n, len(w))
        grams = {" " + " ".join(w[k : k + size]) + " " for k in range(len(w) - size + 1)} if size else set()
        out |= {(d, item) for d, t in padded.items() if any(g in t for g in grams)}
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, "c") for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, e, **kw).collect()}


DOCUMENTS = [
    (1, f"before {LONG} after"), (2, "x " + " ".join(LONG.split()[3:16]).upper() + "!"), (3, " ".join(LONG.split()[:12])), (4, "Short, item… here"), (5, "short item there here"),
    (6, "ﬁne Ｆｕｌｌ width"), (7, None), (8, ""), (1, f"before {LONG} after"), (None, LONG), (9, "word0_word1"), (10, "item"), (11, "日本語の文 テスト"),
]
EVAL = [(100, LONG), (101, "short item here"), (102, "fine full"), (103, None), (104, "?!"), (105, "item"), (106, "日本語の文"), (100, LONG), (107, "word0 word1")]


def test_against_brute_force(spark):
    want = brute(DOCUMENTS, EVAL)
    assert found(spark, DOCUMENTS, EVAL) == want and (2, 100) in want and (3, 100) not in want and (6, 102) in want and (9, 107) in want


def test_passes_find_the_same(spark):
    assert found(spark, DOCUMENTS, EVAL, max_words=5) == brute(DOCUMENTS, EVAL)


def test_empty_tables(spark):
    assert found(spark, [], EVAL) == set() and found(spark, DOCUMENTS, []) == set()


def test_whole_tables_against_brute_force(spark):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{TINY}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{TINY}/eval_items.parquet'").fetchall()
    assert {tuple(r) for r in queries.p7_found(spark, TINY).collect()} == brute(docs, items)


def test_cutting_spans(spark):
    d = spark.createDataFrame([(i, t, 1) for i, t in DOCUMENTS], DOCS)
    e = spark.createDataFrame([(100, LONG, "c")], ITEMS)
    got = {r.doc_id: (r.n_spans, r.text) for r in leaks.remove_leaks(d, e).collect()}
    assert got == {1: (1, "before  after"), 2: (1, "x !")}
    assert leaks.cut_spans("only words", [(0, 2)]) == (1, 10, None)


def test_spans_point_into_the_stored_text():
    text = "Ａb ﬁx éa İstanbul"
    assert [text[s:e] for _, s, e in word_spans(text)][0] == "Ａb"
    assert [w for w, *_ in word_spans(text)] == normal_words(text)


def test_passes_cut_the_same_spans(spark):
    other = " ".join(f"term{i}" for i in range(15))
    docs = [(1, f"a {LONG} b {other} c"), (2, f"{LONG}"), (3, "nothing here")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS)
    e = spark.createDataFrame([(1, LONG, "c"), (2, other, "c"), (3, LONG, "c")], ITEMS)
    for words in (5, 2_000_000):
        got = {r.doc_id: (r.n_spans, r.text) for r in leaks.remove_leaks(d, e, max_words=words).collect()}
        assert got == {1: (2, "a  b  c"), 2: (1, None)}
    assert leaks.remove_leaks(d.limit(0), e).count() == 0 and leaks.remove_leaks(d, e.limit(0)).count() == 0
