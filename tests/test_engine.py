import json
import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from faultline.operators import adjudicate, store
from faultline.operators.align import GAP_EXTEND, GAP_OPEN, coarse, contrast, gotoh
from faultline.operators.detectors import signals
from faultline.operators.steps import enrich
from faultline.sources.otlp import decode, is_raw_upload
from faultline.sources.turns import iso_duration_ns, turns_to_steps
from faultline.streaming.signals import failing_by_window, read_spans


def test_alignment_goldens():
    score, ops, _ = gotoh(coarse([1, 2, 3, 4, 5], [1, 3, 4, 5, 6]))
    assert score == pytest.approx(2.0) and ops == ["match", "insertion", "match", "match", "match", "deletion"]
    score, ops, _ = gotoh(coarse(["x", "y1", "y2", "y3", "z"], ["x", "z"]))
    assert score == pytest.approx(0.6) and ops == ["match", "insertion", "insertion", "insertion", "match"]
    assert gotoh(coarse([], "abc"))[:2] == (pytest.approx(-1.4), ["deletion"] * 3)


def test_alignment_matches_brute_force():
    r = random.Random(1)
    for _ in range(150):
        a, b = (tuple(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(2))

        @lru_cache(None)
        def best(i, j, at, a=a, b=b):
            if i == len(a) and j == len(b):
                return 0.0
            ways = []
            if i < len(a) and j < len(b):
                ways.append((1 if a[i] == b[j] else -1) + best(i + 1, j + 1, 0))
            if i < len(a) and at != 2:  # a gap opens from a pairing or the start only
                ways.append((GAP_EXTEND if at == 1 else GAP_OPEN) + best(i + 1, j, 1))
            if j < len(b) and at != 1:
                ways.append((GAP_EXTEND if at == 2 else GAP_OPEN) + best(i, j + 1, 2))
            return max(ways, default=-1e18)

        score, ops, _ = gotoh(coarse(a, b))
        assert score == pytest.approx(best(0, 0, 0))
        told, last, x, y = 0.0, "", 0, 0
        for o in ops:
            gap = o in ("insertion", "deletion")
            assert not (gap and last in ("insertion", "deletion") and last != o)
            told += (GAP_EXTEND if o == last else GAP_OPEN) if gap else (1 if a[x] == b[y] else -1)
            x, y, last = x + (o != "deletion"), y + (o != "insertion"), o
        assert told == pytest.approx(score) and (x, y) == (len(a), len(b))


def test_gaps_open_from_pairings_only():
    assert gotoh(coarse(list("xxxxx"), list("yyyyy")))[0] == pytest.approx(-4.2)


def test_contrast_of_a_run_in_its_own_pool():
    assert contrast(list("abcabc"), [list("abcabc")] * 4) == []
    assert contrast(list("abxxbc"), [list("abcabc")] * 2) == []
    assert contrast(list("abxxbc"), [list("abcabc")] * 4)[0][0] == 2


def _run(spark, rows, outcome="failure", goal="swap seat 12345"):
    steps = spark.createDataFrame([("t", i, f"s{i}", k, "act", sig, None, 0, i, i + 1, float(ms)) for i, (k, sig, ms, _, _) in enumerate(rows)], "trace_id string, step_index int, span_id string, kind string, actor string, signature string, summary string, depth int, start_ns long, end_ns long, duration_ms double")
    spans = spark.createDataFrame([("t", f"s{i}", st, None if p is None else json.dumps(p), 0) for i, (_, _, _, st, p) in enumerate(rows)], "trace_id string, span_id string, status string, payload string, start_ns long")
    traces = spark.createDataFrame([("t", None, outcome, goal, None, None, None, None, None)], "trace_id string, ingested_at timestamp, outcome string, task_goal string, agent_key string, task_key string, framework string, source string, root_span_id string")
    return enrich(steps.union(steps), spans.union(spans), traces)


def _fired(df):
    return {(r.detector, r.step_index) for r in signals(df).collect()}


def test_detectors_fire_and_stay_silent(spark):
    tool = lambda **k: {"tool_name": "find", "arguments_json": "{}", "result_text": "3 rows", "result_len": 6, "is_error": False, **k}
    llm = lambda text, **k: {"response_messages": [{"role": "assistant", "content": text}], "request_messages": [], "tool_calls": [], **k}
    clean = [("agent", "agent:a:invoke", 10, "ok", {"agent_name": "a"}), ("tool", "tool:a:find:ok", 10, "ok", tool()), ("llm", "llm:a:answer", 10, "ok", llm("here it is"))]
    assert _fired(_run(spark, clean, "success")) == set()
    bad = [
        ("tool", "tool:a:find:err", 10, "error", tool(is_error=True)), ("llm", "llm:a:answer", 10, "ok", llm("all done, success")), ("tool", "tool:a:find:empty", 10, "ok", tool(result_text="", result_len=0)),
        ("tool", "tool:a:find:empty", 10, "ok", tool(result_text="", result_len=0)), ("tool", "tool:a:find:empty", 10, "ok", tool(result_text="", result_len=0)), ("llm", "llm:a:call:ghost", 10, "ok", llm("hm", tool_calls=[{"tool_name": "ghost"}], total_tokens=95, max_tokens=100)),
        ("retriever", "retr:a:w3:hit", 10, "ok", {"query": "weather in spain", "documents": [{"doc_id": "d", "score": 0.1}]}), ("tool", "tool:a:find:ok", 900, "ok", tool(arguments_json='{"ref": "zz-99871"')), ("llm", "llm:a:answer", 10, "ok", llm("bye")),
    ]
    assert _fired(_run(spark, bad)) == {
        ("tool_error", 0), ("error_swallowed", 0), ("empty_tool_result", 2), ("empty_tool_result", 3), ("empty_tool_result", 4), ("retry_storm", 2), ("context_overflow", 5), ("hallucinated_tool", 5),
        ("low_score_retrieval", 6), ("goal_token_drift", 6), ("stall_timeout", 7), ("tool_arg_malformed", 7),
    }


def test_null_payloads_never_fire(spark):
    assert _fired(_run(spark, [("tool", None, 0, None, None), ("llm", None, 0, None, None), ("retriever", None, 0, None, None), ("agent", None, 0, None, None)])) == set()


def _pb(field, wire, value):
    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    return varint(field << 3 | wire) + (varint(len(value)) + value if wire == 2 else value if wire == 1 else varint(value))


def test_protobuf_and_json_agree(spark):
    attr = _pb(1, 2, b"k") + _pb(2, 2, _pb(3, 0, 7))
    span = _pb(1, 2, bytes.fromhex("aa" * 16)) + _pb(2, 2, bytes.fromhex("bb" * 8)) + _pb(5, 2, b"step") + _pb(6, 0, 1) + _pb(7, 1, (5).to_bytes(8, "little")) + _pb(8, 1, (9).to_bytes(8, "little")) + _pb(9, 2, attr) + _pb(15, 2, _pb(3, 0, 2) + _pb(2, 2, b"bad"))
    body = _pb(1, 2, _pb(2, 2, _pb(2, 2, span)))
    text = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "aa" * 16, "spanId": "bb" * 8, "name": "step", "kind": "SPAN_KIND_INTERNAL", "startTimeUnixNano": "5", "endTimeUnixNano": "9", "attributes": [{"key": "k", "value": {"intValue": "7"}}], "status": {"code": "STATUS_CODE_ERROR", "message": "bad"}}]}]}]}
    a = decode(spark.createDataFrame([(1, bytearray(body))], "id long, body binary"), "body", "id", protobuf=True).first()
    b = decode(spark.createDataFrame([(1, json.dumps(text))], "id long, body string"), "body", "id").first()
    assert a == b and a.parent_span_id is None and a.error is None
    assert decode(spark.createDataFrame([(1, "{nope")], "id long, body string"), "body", "id").first().error
    kinds = spark.createDataFrame([('{"spans": []}',), ('{"resourceSpans": [], "spans": []}',), ("x",), (None,)], "b string").select(is_raw_upload(F.col("b")).alias("r")).collect()
    assert [r.r for r in kinds] == [True, False, False, False]


def test_turns_and_durations(spark):
    df = spark.createDataFrame([("c", [("A", "look at this"), ("A", "search_web(query)"), ("A", "run(1)"), ("T", "exitcode: 1 (execution failed)\nCode output: boom"), ("T", None)])], "case_id string, messages array<struct<agent string, content string>>")
    assert [(r.kind, r.status, r.tool_name) for r in turns_to_steps(df).orderBy("step_index").collect()] == [("agent", "ok", None), ("retriever", "ok", "search_web"), ("tool", "ok", "run"), ("tool", "error", "execution_result"), ("agent", "ok", None)]
    d = spark.createDataFrame([("PT1.5S",), ("PT1H2M",), (None,), ("soon",)], "d string").select(iso_duration_ns(F.col("d")).alias("n")).collect()
    assert [r.n for r in d] == [1_500_000_000, 3_720_000_000_000, 0, None]


def test_store_keeps_the_latest_version(spark, tmp_path):
    path = str(tmp_path / "steps")
    mk = lambda rows: spark.createDataFrame(rows, "trace_id string, step_index int")
    store.append(mk([("a", 0), ("a", 1), ("b", 0)]), path, 1)
    store.append(mk([("a", 0)]), path, 2)
    assert sorted(tuple(r) for r in store.latest(spark, path).collect()) == [("a", 0), ("b", 0)]
    assert store.lookup(spark, path, "b").count() == 1


def test_adjudicate_isolates_failures(spark):
    def call(prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return '```json\n{"is_root_cause": true, "failure_class": "unknown", "confidence": 0.5, "cited_step_indices": [1]}\n```' if prompt == "ok" else "no json"

    got = {r.key: (r.is_root_cause, r.error is None) for r in adjudicate.adjudicate(spark.createDataFrame([("1", "ok"), ("2", "boom"), ("3", "bad")], "key string, prompt string"), call).collect()}
    assert got == {"1": (True, True), "2": (None, False), "3": (None, False)}


def test_stream_equals_table(spark, tmp_path):
    rows = [{"trace_id": "t", "span_id": f"s{i % 7}", "kind": "tool", "status": "error" if i % 2 else "ok", "start_ns": 1_780_000_200 * 10**9 + (i % 7) * 400 * 10**9} for i in range(14)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(map(json.dumps, rows[:7])))
    q = failing_by_window(read_spans(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = failing_by_window(spark.createDataFrame(rows[:7]))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))
