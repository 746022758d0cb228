import json

from faultline.operators.drift import changes, load_lines, path_types, unify


def _files(spark, files):
    rows = []
    for seq, lines in enumerate(files, 1):
        for n, (span, attrs) in enumerate(lines, 1):
            rows.append(("p", "llm_payload", seq, n, None, json.dumps({"span_id": span, "kind": "llm", "status": "ok", **attrs})))
    return spark.createDataFrame(rows, "producer string, layout string, file_seq int, line_no int, written_at timestamp, body string")


def test_changes(spark):
    files = _files(spark, [
        [("a", {"prompt_tokens": 10, "model": "m", "old": 1}), ("b", {"prompt_tokens": 20, "model": "n"}), ("b", {"prompt_tokens": 20, "model": "n"})],
        [("b", {"usage": {"input": 20}, "model": "n", "extra": 7}), ("c", {"usage": {"input": 30}, "model": None})],
        [("c", {"usage": {"input": "30"}, "model": "x", "extra": 7}), ("d", {"usage": {"input": "31"}, "extra": 8})],
    ])
    got = {tuple(r)[1:] for r in changes(load_lines(files)).collect()}
    assert got == {(2, "renamed", "prompt_tokens", "usage.input"), (2, "removed", "old", ""), (2, "added", "", "extra"), (3, "type_changed", "usage.input", "usage.input")}


def test_majority_type_and_all_null(spark):
    files = _files(spark, [[("a", {"x": 1, "y": None}), ("b", {"x": 2}), ("c", {"x": "3"})]])
    assert {(r.path, r.type) for r in path_types(load_lines(files)).collect()} == {("x", "integer"), ("y", None)}


def test_one_table_and_failed_casts(spark):
    files = _files(spark, [[("a", {"prompt_tokens": 10}), ("b", {"prompt_tokens": 11})], [("b", {"input_tokens": 11}), ("c", {"input_tokens": "many"})]])
    table, _, failed = unify(files)
    assert {(r.file_seq, r.span_id, r.prompt_tokens) for r in table.collect()} == {(1, "a", 10), (1, "b", 11), (2, "b", 11), (2, "c", None)}
    assert [(r.path, r.column, r.failed) for r in failed.collect()] == [("input_tokens", "prompt_tokens", 1)]


def test_empty_and_invalid(spark):
    files = _files(spark, [[("a", {"x": 1})]])
    assert changes(load_lines(files.limit(0))).count() == 0
    bad = files.unionByName(spark.createDataFrame([("p", "llm_payload", 2, 1, None, "{oops")], files.schema))
    assert changes(load_lines(bad)).count() == 0
