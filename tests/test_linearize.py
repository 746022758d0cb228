import json

from faultline.operators.linearize import linearize, place

SCHEMA = "trace_id string, span_id string, parent_span_id string, name string, kind string, status string, start_ns long, end_ns long, payload string, depth int"


def _span(t, n, p, kind, start, payload=None, name="x"):
    return (t, n, p, name, kind, "ok", start, start + 2_000_000, json.dumps(payload) if payload is not None else None, 7)


ROWS = [
    _span("a", "r", None, "chain", 0, name="boss"),
    # equal starts: by id; the actor is inherited, the first model step of an actor plans unless it calls
    _span("a", "m2", "r", "llm", 5, {"tool_calls": []}), _span("a", "m1", "r", "llm", 5, {"tool_calls": [{"tool_name": "find"}]}), _span("a", "g", "r", "guardrail", 6),
    _span("a", "ag", "r", "agent", 7, {"agent_name": "helper"}), _span("a", "t", "ag", "tool", 8, {"tool_name": "find", "result_text": " [] ", "result_len": 2}), _span("a", "h1", "ag", "llm", 9, {}), _span("a", "h2", "ag", "llm", 10, {}),
    _span("a", "q", "gone", "retriever", 20, {"query": "a  b c", "documents": [{"doc_id": "d"}]}), _span("a", "me", "ME", "tool", 21, None, "bare"), _span("a", "end", "q", "embedding", 99),
    # a circle of two with one below it
    _span("a", "c1", "c2", "tool", 30, {"tool_name": "one", "result_text": "ok", "result_len": 2}), _span("a", "c2", "c1", "tool", 31, {"tool_name": "two", "is_error": True}), _span("a", "c3", "c2", "chain", 32),
    # no span without a parent: the earliest of all is the root; no steps; nulls
    _span("b", "k2", "k1", "llm", 4, {}), _span("b", "k1", "k2", "llm", 3, {}, None), _span("e", "x", None, "chain", 0), (None, "x", None, None, None, None, None, None, None, 1), _span("f", "n", None, "tool", None, {}) if False else ("f", "n", None, None, "tool", None, None, None, "{}", 0),
]


def test_linearize(spark):
    df = spark.createDataFrame([*ROWS, ROWS[1]], SCHEMA)
    got = sorted(linearize(df).collect(), key=lambda r: (r.trace_id, r.step_index))
    a = [(r.span_id, r.signature, r.depth, r.tree_path, ",".join(r.collapsed_span_ids)) for r in got if r.trace_id == "a"]
    assert a == [
        ("m1", "llm:boss:call:find", 1, "0.0", "r"), ("m2", "llm:boss:answer", 1, "0.1", ""), ("ag", "agent:helper:invoke", 1, "0.3", "g"), ("t", "tool:helper:find:empty", 2, "0.3.0", ""),
        ("h1", "llm:helper:plan", 2, "0.3.1", ""), ("h2", "llm:helper:answer", 2, "0.3.2", ""), ("q", "retr:boss:w3:hit", 1, "0.4", ""), ("me", "tool:boss:bare:ok", 1, "0.5", "end"),
        ("c1", "tool:boss:one:ok", 1, "0.6", ""), ("c2", "tool:boss:two:err", 2, "0.6.0", "c3"),
    ]
    assert [(r.trace_id, r.span_id, r.actor, r.duration_ms) for r in got if r.trace_id != "a"] == [("b", "k1", "unknown", 2.0), ("b", "k2", "unknown", 2.0), ("f", "n", "unknown", 0.0)]
    assert {r.node for r in place(df).where("is_orphan").collect()} == {"q", "me", "c1"}
    assert linearize(df.limit(0)).count() == 0
