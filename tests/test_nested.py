import json

from faultline.operators.nested import links, message_table, part_table, span_table
from faultline.operators.shred import shred, triples

TRAIL = {"trace_id": "t", "spans": {"span_id": "a", "child_spans": [None, {"span_id": "b", "child_spans": [{"span_id": "c", "child_spans": None}]}]}}
OI = {"resourceSpans": [None, {"scopeSpans": {"spans": [{"spanId": "s1"}, None, {"spanId": "s2"}]}}]}
RAW = {"spans": [{"span_id": "x", "attributes": {"request_messages": [None, {"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "text", "text": "p"}, None, {"type": "text", "text": "q"}]}, {"role": "user", "content": {"type": "text", "text": "lone"}}, {"role": "user", "content": None}]}}]}


def _records(spark, *bodies):
    return spark.createDataFrame([(i, lay, "src", b) for i, (lay, b) in enumerate(bodies)], "record_id long, layout string, source string, body string")


def test_links(spark):
    df = _records(spark, ("trail", json.dumps(TRAIL)), ("openinference", "﻿" + json.dumps(OI)), ("raw_upload", json.dumps(RAW)), ("trail", "{broken"), ("trail", None), ("trail", "[1, NaN]"))
    got = {tuple(r) for r in links(df).collect()}
    assert got == {
        (0, "child_span", "", "a"), (0, "child_span", "a", "b"), (0, "child_span", "b", "c"),
        (1, "span", "1/0", "s1"), (1, "span", "1/0", "s2"),
        (2, "message", "x", "1"), (2, "message", "x", "2"), (2, "message", "x", "3"), (2, "message", "x", "4"),
        (2, "part", "x/2", "0"), (2, "part", "x/2", "2"), (2, "part", "x/3", "0"),
    }


def test_flat_tables(spark):
    df = _records(spark, ("raw_upload", json.dumps(RAW)), ("trail", json.dumps(TRAIL)))
    assert {(r.position, r.content) for r in message_table(df).collect()} == {(1, "hi"), (2, None), (3, None), (4, None)}
    assert {(r.message_position, r.position, r.text) for r in part_table(df).collect()} == {(2, 0, "p"), (2, 2, "q"), (3, 0, "lone")}
    assert {(r.span_id, r.nested_in) for r in span_table(df).where("layout = 'trail'").collect()} == {("a", ""), ("b", "a"), ("c", "b")}


def test_deep_nesting_and_empty(spark):
    deep = {"span_id": "n0", "child_spans": []}
    for i in range(1, 150):
        deep = {"span_id": f"n{i}", "child_spans": [deep]}
    df = _records(spark, ("trail", json.dumps({"spans": [deep]})), ("trail", "[" * 200_000))
    assert links(df).count() == 150
    assert links(df.limit(0)).count() == 0


def test_triples_keep_types_and_numbers_as_written(spark):
    df = spark.createDataFrame([(1, '{"a": 1.50, "b": {"c": [1, 2]}, "d": true, "e": null, "f": "1"}')], "id long, body string")
    got = {(r.path, r.value, r.type) for r in triples(shred(df, ["id"], "body", []), ["id"]).collect()}
    assert got == {("a", "1.50", "number"), ("b.c", "[1,2]", "array"), ("d", "true", "boolean"), ("e", None, "null"), ("f", "1", "string")}
