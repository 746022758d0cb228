"""Synthetic runs of a desk agent with a known fault: ground truth for detectors, contrast and evaluation.

A run is a list of steps (dicts with kind, actor, signature, status, ms and payload). Seeds give the same run everywhere. An
injector changes a copy of a run around a wanted step and names the step that is to blame.
"""

from __future__ import annotations

import copy
import json
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DESK, LEAD = "desk_agent", "desk_lead"
GAP_NS, BASE_NS = 2_000_000_000, 1_755_000_000_000_000_000
Run = list[dict]


def draw(*key) -> int:
    """A number below 10**6 that depends on the key only."""
    return zlib.crc32("|".join(map(str, key)).encode()) % 1_000_000


def _llm(text: str, asked: str = "go on", calls: tuple[str, ...] = (), tokens: int = 600) -> dict:
    return {"provider": "inhouse", "model": "orchard-7b", "request_messages": [{"role": "user", "content": asked}], "response_messages": [{"role": "assistant", "content": text}], "tool_calls": [{"tool_name": c, "arguments_json": "{}"} for c in calls], "prompt_tokens": tokens, "completion_tokens": 80, "total_tokens": tokens + 80, "max_tokens": 8000}


def _tool(name: str, result: str, **arguments) -> dict:
    return {"tool_name": name, "arguments_json": json.dumps(arguments), "result_text": result, "result_len": len(result), "is_error": False}


def _step(kind: str, signature: str, payload: dict, actor: str = DESK) -> dict:
    return {"kind": kind, "actor": actor, "signature": signature, "status": "ok", "ms": 1500.0, "payload": payload}


def _call(tool: str, result: str, **arguments) -> Run:
    return [_step("llm", f"llm:{DESK}:call:{tool}", _llm(f"next I ask {tool}", calls=(tool,))), _step("tool", f"tool:{DESK}:{tool}:ok", _tool(tool, result, **arguments))]


def clean_run(seed: int) -> tuple[str, Run]:
    """(goal, steps) of a run that returns the money for a lost parcel: 9 to 13 steps, the first four the same for every seed."""
    order = f"ORD-{10_000 + draw(seed, 'order') % 90_000}"
    goal = f"Refund order {order} under the refund policy: the parcel was lost"
    notes = [f"refund policy note {i} about lost parcel cases of kind {draw(seed, 'doc', i) % 50}" for i in range(1 + draw(seed, "docs") % 3)]
    steps = [_step("agent", f"agent:{LEAD}:invoke", {"agent_name": LEAD, "role": "lead", "input_text": goal, "output_text": "", "delegated_to": [DESK]}, LEAD), _step("llm", f"llm:{DESK}:plan", _llm("first the order, then the policy, then the money", goal)), *_call("search_orders", f"{order} was sent and lost", order=order)]
    blocks = [[_step("retriever", f"retr:{DESK}:w2:hit", {"query": "refund policy", "documents": [{"doc_id": f"note-{i}", "content_len": len(n), "content_preview": n, "score": 0.6 + i / 10} for i, n in enumerate(notes)], "top_k": len(notes)}), _step("llm", f"llm:{DESK}:answer", _llm("the policy covers it", " ".join(notes)))]]
    blocks += [_call("check_duplicate_refund", "none so far", order=order)] if draw(seed, "dup") % 2 else []
    blocks.append(_call("verify_eligibility", "eligible", order=order))
    for b in sorted(blocks, key=lambda b: draw(seed, b[-1]["signature"])):
        steps += b
    return goal, [*steps, *_call("process_refund", f"money for {order} is on its way", order=order), _step("llm", f"llm:{DESK}:answer", _llm(f"{order} is settled", tokens=900))]


def _near(run: Run, kind: str, at: int) -> int:
    return min((i for i, s in enumerate(run) if s["kind"] == kind), key=lambda i: (abs(i - at), i))


def _edit(kind: str, **payload) -> Callable[[Run, int], tuple[Run, int]]:
    """An injector that changes payload fields of the nearest step of a kind; status and ms of the step if so named."""

    def run(r: Run, at: int) -> tuple[Run, int]:
        i = _near(r, kind, at)
        for k, v in payload.items():
            (r[i] if k in ("status", "ms", "signature") else r[i]["payload"])[k] = v
        return r, i

    return run


def _swallowed(r: Run, at: int) -> tuple[Run, int]:
    r, i = _edit("tool", result_text="[]", result_len=2)(r, at)
    r.insert(i + 1, _step("llm", f"llm:{DESK}:answer", _llm("all done, the order was processed")))
    return r, i


def _repeats(times: int, vary: bool) -> Callable[[Run, int], tuple[Run, int]]:
    def run(r: Run, at: int) -> tuple[Run, int]:
        i = _near(r, "tool", at)
        for k in range(times):
            again = copy.deepcopy(r[i])
            again["payload"]["result_text"] += f" try {k}" if vary else ""
            r.insert(i + 1, again)
        return r, i

    return run


def _oscillation(r: Run, at: int) -> tuple[Run, int]:
    i = _near(r, "tool", at)
    r[i + 1 : i + 1] = [_step("tool", f"tool:{DESK}:{n}:ok", _tool(n, f"row {k}", page=k)) for k, n in enumerate(["look_left", "look_right"] * 2)]
    return r, i + 1


def _truncation(r: Run, at: int) -> tuple[Run, int]:
    i = _near(r, "llm", at)
    j = next(k for k in range(i + 1, len(r)) if r[k]["kind"] == "llm")
    r[i]["payload"]["prompt_tokens"], r[j]["payload"]["prompt_tokens"] = 6000, 3800
    r[j]["payload"]["request_messages"] = [{"role": "user", "content": "and"}] * 3
    return r, j


def _budget(r: Run, at: int) -> tuple[Run, int]:
    i = _near(r, "llm", at)
    return [*r[: i + 1], *(_step("llm", f"llm:{DESK}:plan", _llm("once more")) for _ in range(40))], i


def _premature(r: Run, at: int) -> tuple[Run, int]:
    i = _near(r, "llm", at)
    return [*r[: i + 1], _step("llm", f"llm:{DESK}:answer", _llm("that is all"))], i


def _unverified(r: Run, at: int) -> tuple[Run, int]:
    r = [s for s in r if "verify_eligibility" not in s["signature"]]
    return r, next(i for i, s in enumerate(r) if s["signature"].startswith("tool:") and "process_refund" in s["signature"])


INJECTORS: dict[str, Callable[[Run, int], tuple[Run, int]]] = {
    "tool_error": _edit("tool", status="error", is_error=True, error_message="no route"), "empty_tool_result": _edit("tool", result_text="null", result_len=4), "error_swallowed": _swallowed, "oscillation": _oscillation,
    "repeated_identical_action": _repeats(2, True), "retry_storm": _repeats(3, False), "context_overflow": _edit("llm", total_tokens=7800), "silent_history_truncation": _truncation, "step_budget_exhausted": _budget,
    "output_schema_violation": _edit("llm", response_format_schema='{"required": ["verdict"]}'), "tool_arg_malformed": _edit("tool", arguments_json='{"order": '), "hallucinated_tool": _edit("llm", tool_calls=[{"tool_name": "teleport_parcel", "arguments_json": "{}"}]),
    "premature_termination": _premature, "missing_verification": _unverified, "duplicate_delegation": _edit("agent", delegated_to=[DESK, DESK]), "unused_retrieval": _edit("retriever", documents=[{"doc_id": "x", "content_len": 40, "content_preview": "tide tables for seven northern harbours", "score": 0.8}]),
    "low_score_retrieval": _edit("retriever", documents=[{"doc_id": "x", "content_len": 11, "content_preview": "refund policy note about lost parcel", "score": 0.12}]), "goal_token_drift": _edit("retriever", query="tide tables"), "parameter_drift": _edit("tool", arguments_json='{"order": {"id": ["ORD-77x77"]}}'), "stall_timeout": _edit("tool", ms=45_000.0),
    "instruction_noncompliance": _edit("llm", request_messages=[{"role": "system", "content": "Always end with '<done>' please"}, {"role": "user", "content": "go on"}]), "reasoning_turn_defect": _edit("agent", output_text="```python\nfor x in:\n```"),
}


def faulty_run(seed: int, kind: str, at: int = 3) -> tuple[str, Run, int]:
    """(goal, steps, step to blame)."""
    goal, steps = clean_run(seed)
    steps, truth = INJECTORS[kind](copy.deepcopy(steps), at)
    return goal, steps, truth


def tables(spark: SparkSession, runs: dict[str, tuple[str, Run, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """steps, spans and traces of runs: trace_id to (goal, steps, outcome)."""
    st, sp, tr = [], [], []
    for t, (goal, steps, outcome) in runs.items():
        tr.append((t, outcome, goal, "synth", f"{t}-0", len(steps), len(steps)))
        for i, s in enumerate(steps):
            begin, end = BASE_NS + i * GAP_NS, BASE_NS + i * GAP_NS + int(s["ms"] * 1e6)
            st.append((t, i, f"{t}-{i}", s["kind"], s["actor"], s["signature"], s["signature"], min(i, 1), begin, end, s["ms"]))
            sp.append((t, f"{t}-{i}", f"{t}-0" if i else None, s["signature"], s["kind"], s["status"], begin, end, json.dumps(s["payload"])))
    return (
        spark.createDataFrame(st, "trace_id string, step_index int, span_id string, kind string, actor string, signature string, summary string, depth int, start_ns long, end_ns long, duration_ms double"),
        spark.createDataFrame(sp, "trace_id string, span_id string, parent_span_id string, name string, kind string, status string, start_ns long, end_ns long, payload string"),
        spark.createDataFrame(tr, "trace_id string, outcome string, task_goal string, framework string, root_span_id string, span_count int, step_count int").selectExpr("*", "cast(null as timestamp) ingested_at", "cast(null as string) agent_key", "cast(null as string) task_key", "'synth' source"),
    )
