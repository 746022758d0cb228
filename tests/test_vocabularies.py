import json

from pyspark.sql import functions as F

from faultline.sources import cases, records
from faultline.sources.vocabularies import normalize

SCHEMA = "span_id string, parent_span_id string, name string, attributes string, start_ns long, end_ns long, status_code string, status_message string, kind string, status string, actor string, start_time string, end_time string"
ARGS = '{"q": 1}'
CALL = [{"role": "assistant", "content": None, "tool_calls": [{"id": "c", "function": {"name": "find", "arguments": ARGS}}]}]


def _otlp(n, attrs, code="STATUS_CODE_OK", start=5):
    return (n, None, "x", attrs if isinstance(attrs, str) or attrs is None else json.dumps(attrs), start, 9, code, "why", None, None, None, None, None)


def _upload(n, kind, attrs, status="ok", start="2026-01-02T03:04:05.123456789Z"):
    return (n, None, "x", json.dumps(attrs), None, None, None, None, kind, status, "act", start, "2026-01-02T03:04:06+01:00")


GENAI = {
    "g1": {"gen_ai.operation.name": "chat", "gen_ai.request.model": "m", "gen_ai.input.messages": json.dumps([{"role": "user", "content": "hi"}, {}]), "gen_ai.output.messages": json.dumps(CALL), "gen_ai.usage.input_tokens": 3, "gen_ai.usage.output_tokens": 4, "gen_ai.response.finish_reasons": ["stop"]},
    "g2": {"gen_ai.operation.name": "execute_tool", "gen_ai.tool.name": "find", "gen_ai.tool.call.arguments": "{broken", "gen_ai.tool.call.result": "abc"},
    "g3": {"gen_ai.operation.name": "retrieve_documents", "gen_ai.retrieval.query": "q", "gen_ai.retrieval.documents": json.dumps([{"id": "d", "content": "x" * 300, "score": 0.5}, {"content": ""}])},
    "g4": {"gen_ai.operation.name": "chat", "gen_ai.input.messages": "[broken"}, "g5": {"gen_ai.operation.name": "weird"},
}
INFERENCE = {
    "o1": {"openinference.span.kind": "LLM", **{f"llm.input_messages.{i}.message.content": str(i) for i in (10, 2, 0)}, "llm.output_messages.0.message.tool_calls.1.tool_call.function.name": "b", "llm.output_messages.0.message.tool_calls.0.tool_call.function.name": "a", "llm.output_messages.0.message.tool_calls.0.tool_call.function.arguments": ARGS, "llm.invocation_parameters": '{"temperature": 0.25}', "llm.token_count.total": 7, "llm.token_count.max": 9},
    "o2": {"openinference.span.kind": "AGENT", "metadata": '{"agent_name": "boss"}', "input.value": "do"}, "o3": {"openinference.span.kind": "RETRIEVER", "retrieval.documents.3.document.content": "abc"}, "o4": {"openinference.span.kind": "AGENT", "metadata": "nope"},
}


def _norm(spark):
    rows = [_otlp(k, v) for k, v in (GENAI | INFERENCE).items()] + [_otlp("e", GENAI["g2"], "STATUS_CODE_ERROR"), _otlp("n", None), _otlp("t", {"openinference.span.kind": "CHAIN"}, start=None)]
    rows += [_upload("u1", "llm", {"model": "m", "prompt_tokens": 1, "request_messages": [None, {"role": "user", "content": "hi"}], "response_messages": [{"content": "ok", "tool_calls": [{"name": "find", "arguments": {"q": 1}}]}]}), _upload("u2", "agent", {"delegated_to": ["a", "a"]}), _upload("u3", "tool", {}, "what"), _upload("u4", "tool", {"is_error": True, "error_message": "bad"}), _upload("u5", "tool", {}, start="2026-01-02 03:04:05")]
    return {r.span_id: r for r in normalize(spark.createDataFrame(rows, SCHEMA).withColumn("p", F.lit(1)).withColumn("vocabulary", F.lit("clash"))).collect()}


def test_vocabularies(spark):
    r = _norm(spark)
    g1, g3, o1, u1 = r["g1"].p, r["g3"].p, r["o1"].p, r["u1"].p
    assert (g1.model, g1.total_tokens, g1.finish_reason, [m.role for m in g1.request_messages], [(c.tool_name, c.arguments_json) for c in g1.tool_calls]) == ("m", 7, "stop", ["user", "unknown"], [("find", ARGS)])
    assert (r["g2"].p.arguments_json, r["g2"].p.result_len, r["g2"].p.is_error, r["e"].p.is_error, r["e"].p.error_message) == ("{broken", 3, False, True, "why")
    assert [(d.doc_id, d.content_len, len(d.content_preview), d.score) for d in g3.documents] == [("d", 300, 200, 0.5), ("doc-1", 0, 0, None)]
    assert ([m.content for m in o1.request_messages], [(c.tool_name, c.arguments_json) for c in o1.tool_calls], o1.temperature, o1.total_tokens, o1.max_tokens) == (["0", "2", "10"], [("a", ARGS), ("b", "{}")], 0.25, 7, 9)
    assert (r["o2"].p.agent_name, r["o2"].p.input_text, r["o3"].p.documents[0].doc_id) == ("boss", "do", "doc-3")
    assert (len(u1.request_messages), u1.total_tokens, u1.tool_calls[0].arguments_json.replace(" ", ""), r["u1"].start_ns, r["u1"].end_ns) == (1, None, '{"q":1}', 1767323045123456000, 1767319446000000000)
    assert (r["u2"].p.agent_name, r["u2"].p.delegated_to, r["u4"].p.is_error, r["u4"].p.error_message) == ("act", ["a", "a"], True, "bad")


def test_what_cannot_be_normalised_stays(spark):
    r = _norm(spark)
    for k in ("g4", "o4", "n", "t", "u3", "u5"):
        assert r[k].kind == "unknown" and r[k].p is None and r[k].normalize_error
    assert r["g5"].kind == "unknown" and r["g5"].normalize_error is None and r["g4"].vocabulary == "otel_genai" and "[broken" in r["g4"].attributes
    assert normalize(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ingest_headers_goals_and_keys(spark):
    rows = [_otlp("a", INFERENCE["o2"]), _otlp("b", GENAI["g1"]), _otlp("c", GENAI["g2"], "STATUS_CODE_ERROR")]
    spans = normalize(spark.createDataFrame(rows, SCHEMA).withColumn("trace_id", F.lit("t1")).withColumn("ord", F.col("span_id")), ["ord"])
    up = normalize(spark.createDataFrame([_upload("u2", "agent", {})], SCHEMA).withColumn("trace_id", F.lit("t2")).withColumn("ord", F.lit("0")), ["ord"])
    heads = spark.createDataFrame([("t2", "", None, "goal 7", "odd")], "trace_id string, source string, framework string, task_goal string, outcome string")
    traces, _, steps = records.ingest(spans.unionByName(up), heads)
    got = {r.trace_id: r for r in traces.collect()}
    assert (got["t1"].source, got["t1"].outcome, got["t1"].task_goal, got["t1"].span_count, got["t1"].step_count) == ("otlp", "failure", "do", 3, 3)
    assert (got["t2"].source, got["t2"].outcome, got["t2"].task_goal) == ("manual_upload", "unknown", "goal 7")
    goals = spark.createDataFrame([("See https://a.b/c?d=1 or Mail.me@x.org on 2026-01-02  for 77",), ("see https://z  or me@y.com on 2025-12-31 for 1",), (None,), ("",)], "g string").select(records.masked_task_key(F.col("g")).alias("k")).collect()
    assert goals[0].k == goals[1].k and goals[2].k == goals[3].k
    assert [r.f for r in spark.createDataFrame([("Application/JSON; charset=utf-8",), ("application/x-protobuf",), ("text/csv",), (None,)], "c string").select(records.wire_format(F.col("c")).alias("f")).collect()] == ["json", "protobuf", None, None]


def test_cases(spark):
    steps = spark.createDataFrame([("7", "s1", 0, ["root"]), ("7", "s2", 1, [])], "trace_id string, span_id string, step_index int, collapsed_span_ids array<string>")
    body = json.dumps({"errors": [{"category": " Goal-Deviation ", "location": "S2"}, {"category": "odd", "location": "root"}, {"category": "x", "location": "gone"}, None]})
    recs = spark.createDataFrame([(7, body), (8, "{bad"), (9, None)], "record_id long, body string")
    got = sorted((r.case_id, r.true_step_index, r.true_span_id, r.true_class, r.is_primary) for r in cases.annotated_cases(recs, "record_id", "body", steps).collect())
    assert got == [("7#0", 0, "s1", "unknown", True), ("7#1", 1, "s2", "plan_omission", False)]
    turns = spark.createDataFrame([("a", [("x", "hi")], "0"), ("b", [("x", "hi")], "3"), ("c", None, "0"), ("d", [("x", "y")], "z")], "case_id string, messages array<struct<agent:string,content:string>>, mistake_step string")
    assert [r.case_id for r in cases.turn_cases(turns).collect()] == ["a"]
    files = spark.createDataFrame([("/x/one.json", '[1,]')], "path string, content string"), spark.createDataFrame([("/y/one.txt", '{"a":2,}')], "path string, content string")
    assert [tuple(r) for r in cases.pair_files(*files).collect()] == [("one", "[1]", '{"a":2}')]
    assert spark.range(1).select(cases.plain_role(F.lit("Boss (as lead)")).alias("r")).first().r == "Boss"
