from __future__ import annotations

import json

import duckdb
import pytest
from conftest import SMALL

from palimpsest.functions.json_index import array_objects, parse, record_text
from palimpsest.operators import nested
from palimpsest.plans import problems


def walk(value, path="$", holder="$"):
    """Brute force: every object directly inside an array."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}", holder)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            here = f"{path}/{i}"
            if isinstance(v, dict):
                yield here, holder
                yield from walk(v, here, here)
            else:
                yield from walk(v, here, holder)


def brute(text):
    def no(x):
        raise ValueError(x)

    try:
        value = json.loads(text, parse_constant=no)
        if isinstance(value, str):
            value = json.loads(value, parse_constant=no)
    except (ValueError, TypeError):
        return set()
    return set(walk(value)) if isinstance(value, (dict, list)) else set()


CASES = [
    "", " ", "null", "{}", "[]", "[{}]", '[[{}],[],[{"a":1},{}]]', '{"a":{"b":[{"c":[{"d":1}, 2, {"e":[[{}]]}]}]}}',
    '{"a/b":[{"~":[{}]}], "":[{}]}', '{"q\\"x":[{"s":"}]{[,:\\\\"}]}', '{"\\u00e9":[{}], "k":"[{}]"}', '[{"a":"\\\\"},{"b":"\\\\\\""}]',
    '{"x":[1,{"y":"a,b"},3,{"z":[{"w":null}]}]}', ' \n\t{"a" : [ {"b" : [ ] } , { } ] } ', json.dumps('[{"a":[{}]}]'), json.dumps(json.dumps("[{}]")), json.dumps("[{}"),
    '{"a":[{}]', '{"a":[{}]}}', '[{"a":NaN}]', '[{"a":-Infinity}]', "[{'a':1}]", '[{"a":01}]', '[{"a":1.}]', '[{}],', '﻿[{}]', '[{"a":"\t"}]', '{"日本":[{"ключ":[{}]}]}', '[{"n":1e400}]',
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    record = record_text(text)
    got = {(p, h) for _, p, h, *_ in array_objects([record])} if record is not None else set()
    assert got == brute(text)


def test_batches_are_as_single_records():
    records = [r for t in CASES if (r := record_text(t)) is not None]
    alone = [(i, *x[1:]) for i, r in enumerate(records) for x in array_objects([r])]
    assert sorted(array_objects(records)) == sorted(alone)


def test_spans_and_ordinals():
    rows = array_objects(['{"a":[1,{"b":[{"c":2}]},{"d":"x"}]}'])
    assert [(p, n, t) for _, p, _, n, t in rows] == [("$/a/1", 1, '{"b":[{"c":2}]}'), ("$/a/1/b/0", 0, '{"c":2}'), ("$/a/2", 2, '{"d":"x"}')]


def test_deep_long_and_odd():
    deep = "[" * 20000 + "{}" + "]" * 20000
    assert record_text(deep) == deep
    assert len(array_objects([deep])) == 1
    assert record_text("[" * 20000 + "{}" + "]" * 19999) is None
    assert parse("[" + "1" * 6000 + "]")[0]
    (row,) = array_objects(['{"\\ud800":[{}]}'])
    row[1].encode("utf-8")
    long = json.dumps([{"t": "x" * 100}] * 20000)
    assert len(array_objects([long])) == 20000


def test_whole_tables_against_brute_force(spark):
    con = duckdb.connect()
    want = set()
    for table, field in (("memory_revisions", "content_json"), ("memory_revisions", "metadata_json"), ("spaces", "metadata_json")):
        for i, text in con.execute(f"SELECT DISTINCT id, {field} FROM '{SMALL}/{table}.parquet'").fetchall():
            want |= {(table, field, i, p, h) for p, h in (brute(text) if text else ())}
    rows = [tuple(r) for r in problems.p2_found(spark, SMALL).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_operator_edges(spark):
    schema = "id string, j string, path int, record_id string, v0 string"
    df = spark.createDataFrame([("a", '[{"x":1,"y":{"z":2},"n":null}]', 1, "c", "c"), ("a", '[{"x":1,"y":{"z":2},"n":null}]', 1, "c", "c"), (None, "[{}]", 1, "c", "c"), ("b", None, 1, "c", "c"), ("d", '{"k":[{}],"k":[{}]}', 1, "c", "c")], schema)
    got = sorted((r.record_id, r.path, r.members) for r in nested.flatten(df, "t", "id", ["j"]).collect())
    assert got == [("a", "$/0", {"x": "1", "n": None}), ("d", "$/k/0", {})]
    assert nested.flatten(df.limit(0), "t", "id", ["j"]).count() == 0
    flat = nested.flat_table(nested.flatten(df, "t", "id", ["j"]), "$", {"x": "int", "w": "string"}).collect()
    assert [(r.record_id, r.x, r.w) for r in flat] == [("a", 1, None)]


def kept(value, path=""):
    """Brute force: what an object holds outside the objects of its arrays."""
    items = value.items() if isinstance(value, dict) else enumerate(value)
    for k, v in items:
        at = f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}"
        if isinstance(v, (dict, list)) and v:
            if not (isinstance(value, list) and isinstance(v, dict)):
                yield from kept(v, at)
        elif not (isinstance(value, list) and isinstance(v, dict)):
            yield at[1:], v if v is None or isinstance(v, str) else json.dumps(v)


def test_nested_objects_and_scalar_arrays_are_kept(spark):
    text = '[{"x":1,"y":{"z":2,"e":{},"d":{"a/b":"q","n":null}},"tags":["s",true,[3],{"own":{"v":"w"}}],"none":[]}]'
    df = spark.createDataFrame([("a", text)], "id string, j string")
    got = {r.path: (r.members, r.inner) for r in nested.flatten(df, "t", "id", ["j"]).collect()}
    assert got == {
        "$/0": ({"x": "1"}, {"y/z": "2", "y/e": "{}", "y/d/a~1b": "q", "y/d/n": None, "tags/0": "s", "tags/1": "true", "tags/2/0": "3", "none": "[]"}),
        "$/0/tags/3": ({}, {"own/v": "w"}),
    }
    (row,) = nested.flat_table(nested.flatten(df, "t", "id", ["j"]), "$", {"x": "int"}).collect()
    assert row.x == 1 and row.inner["y/z"] == "2"
    deep = '[{"s":1,"k":' + "[" * 20000 + '{"o":[]},"w"' + "]" * 20000 + "}]"
    members, inner = nested._contents(array_objects([deep])[0][4])
    assert members == [("s", "1")] and [x for _, x in inner] == ["w"]


def test_all_objects_keep_all_they_hold(spark):
    import __spark_entry__ as entry

    con = duckdb.connect()
    texts = {("memory_revisions", f, i): t for f in ("content_json", "metadata_json") for i, t in con.execute(f"SELECT id, {f} FROM '{SMALL}/memory_revisions.parquet'").fetchall()}
    texts |= {("spaces", "metadata_json", i): t for i, t in con.execute(f"SELECT id, metadata_json FROM '{SMALL}/spaces.parquet'").fetchall()}
    rows = entry.queries()["p2_objects"](spark, SMALL).collect()
    objects = {k: {(i, p): t for i, p, _, _, t in array_objects([record_text(texts[k])])} for k in {(r.table_name, r.field, r.record_id) for r in rows}}
    held = 0
    for r in rows:
        value = json.loads(objects[r.table_name, r.field, r.record_id][0, r.path])
        want = dict(kept(value))
        direct = {k: want[k.replace("~", "~0").replace("/", "~1")] for k, v in value.items() if not isinstance(v, (dict, list))}
        assert r.members == direct and r.inner == {k: v for k, v in want.items() if k not in {x.replace("~", "~0").replace("/", "~1") for x in direct}}
        held += bool(r.inner)
    assert held


def test_strings_with_escaped_brackets_are_records(spark):
    texts = {"all": r'"\u007b\u0022a\u0022:\u005b\u007b\u007d\u005d\u007d"', "upper": r' "\u005B\u007B\u007D\u005D"', "half": r'"[\u007b}]"', "text": r'{"a":"\u005b\u007b"}'}
    df = spark.createDataFrame(list(texts.items()), "id string, j string")
    got = {(r.record_id, r.path) for r in nested.flatten(df, "t", "id", ["j"], False).collect()}
    assert got == {("all", "$/a/0"), ("upper", "$/0"), ("half", "$/0")} and all((k, "$/a/0" if k == "all" else "$/0") in got for k, t in texts.items() if brute(t))
