"""Deterministic failure detectors over every trace at once.

Detectors that look at one step and its neighbours are predicates over one wide table, whose window columns
all rest on one partitioning by trace, so any number of them needs one shuffle; Catalyst drops the columns
that a chosen detector does not use. Detectors of runs, of tools never executed and of values from nowhere
have frames of their own. A predicate that is null does not fire. Every signal is
(trace_id, step_index, detector, severity, category).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.steps import is_empty_result, terms

# Fixed values of the detectors.
FAILURE_WORDS = ["error", "fail", "unable", "could not", "couldn't", "sorry", "apolog", "not found", "denied"]
SUCCESS_WORDS = ["success", "done", "complete", "resolved", "issued", "processed", "confirmed"]
ASSUMING = r"(?i)\b(we can simulate|simulate the|simulated dataset|simulated data|let'?s assume|assume that|assuming that|make an assumption|an assumption|dummy data|mock data|placeholder values?|without verifying)\b"
DEMAND = r"""(?i)(?:end with|must contain|respond with|use the format|wrap in|write the|append the)\s+(?:['"`]?\\?n?\s*(<[^>\s]+[^>]*>)|['"`]?\s*(\[\[[^\]\s]+\]\])|['"`]?\s*(###[^#\s]+###)|['"`]?\s*(```[a-zA-Z0-9_-]*)|['"`]([A-Za-z0-9_-]{3,})['"`])"""
HTML_NOISE = ["<i>", "<b>", "<p>", "<br>", "<ul>", "<li>", "<ol>", "<a>", "<div>", "<span>", "<strong>", "<em>", "<pre>", "<code>"]
CODE_BLOCK = r"```(?:python)?\s*\n(.*?)```"
BENIGN_TOOL = "execution_result"
OVERFLOW, TOKEN_DROP, LONG_RUN, LOOP_RUN, COVERAGE, LOW_SCORE, STALL, LEAST_MEDIAN_MS = 0.9, 0.7, 10, 3, 0.15, 0.3, 5.0, 1.0
VERIFY_TOOL, REFUND_TOOL = "verify_eligibility", "process_refund"


def by_step():
    return Window.partitionBy("trace_id").orderBy("step_index")



def _text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " ")


def _words_in(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def _first_of(role: str, messages: Column) -> Column:
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))


def missing_literals(request: Column, response: Column) -> Column:
    """The literals that the first system and the first user message demand and the response lacks, letter case aside."""
    told = F.concat(_first_of("system", request), F.lit("\n"), _first_of("user", request))
    found = [F.regexp_extract_all(told, F.lit(DEMAND), F.lit(g)) for g in range(1, 6)]
    literals = F.array_distinct(F.filter(F.transform(F.arrays_zip(*(x.alias(f"g{i}") for i, x in enumerate(found))), lambda z: F.coalesce(*(F.nullif(z[f"g{i}"], F.lit("")) for i in range(5)), F.lit(""))), lambda x: (x != "") & ~F.lower(x).isin(*HTML_NOISE)))
    return F.filter(literals, lambda x: ~F.contains(F.lower(_text(response)), F.lower(x)))


def breaks_schema(p: Column) -> Column:
    """Whether the first response with content is no JSON object with all keys that the declared schema requires; false without a schema."""
    text = F.get(F.filter(p["response_messages"], lambda m: F.coalesce(m["content"], F.lit("")) != ""), F.lit(0))["content"]
    keys = F.coalesce(F.from_json(F.get_json_object(p["response_format_schema"], "$.required"), "array<string>"), F.array().cast("array<string>"))
    read = F.when(F.try_parse_json(text).isNotNull() & text.rlike(r"(?s)^\s*\{"), F.from_json(text, "map<string,string>"))
    declared = ~F.regexp_replace(F.coalesce(p["response_format_schema"], F.lit("")), r"\s", "").isin("", "{}", "null")
    return declared & ~F.coalesce(F.forall(keys, lambda k: F.map_contains_key(read, k)), F.lit(False))


def wide(enriched: DataFrame) -> DataFrame:
    """The shared table of all row and window detectors."""
    p, kind = F.col("p"), F.col("kind")
    after = by_step().rowsBetween(1, Window.unboundedFollowing)
    llm_text = F.when(kind == "llm", F.lower(_text(p["response_messages"])))
    answers = F.when(kind == "llm", F.coalesce(~_words_in(F.coalesce(llm_text, F.lit("")), FAILURE_WORDS) & _words_in(F.coalesce(llm_text, F.lit("")), SUCCESS_WORDS), F.lit(False)))
    by_actor = Window.partitionBy("trace_id", "actor", "kind").orderBy("step_index")
    w = enriched.select("*", answers.alias("claims_success"), F.when(kind == "tool", is_empty_result()).alias("empty"), F.when(kind == "llm", _text(p["request_messages"])).alias("request_text"))
    return w.select(
        "*",
        F.lead("claims_success", 1).over(by_step()).alias("claims_1"), F.lead("claims_success", 2).over(by_step()).alias("claims_2"),
        F.lead("kind", 1).over(by_step()).alias("kind_next"), F.lag("kind", 1).over(by_step()).alias("kind_before"), F.lag("step_index", 1).over(by_step()).alias("index_before"),
        F.first(F.when(kind == "llm", F.col("request_text")), ignorenulls=True).over(after).alias("next_request"),
        F.lag(p["prompt_tokens"]).over(by_actor).alias("tokens_before"), F.lag(F.size(p["request_messages"])).over(by_actor).alias("messages_before"),
        F.median("duration_ms").over(Window.partitionBy("trace_id", "kind")).alias("median_ms"),
        F.max(F.when(F.contains("signature", F.lit(VERIFY_TOOL)), 1).otherwise(0)).over(Window.partitionBy("trace_id")).alias("verified"),
        F.min(F.when((kind == "tool") & F.contains("signature", F.lit(REFUND_TOOL)), F.col("step_index"))).over(Window.partitionBy("trace_id")).alias("first_refund"),
    )


def _predicates() -> dict[str, tuple[Column, float, str, Column]]:
    """name: (predicate over the wide table, severity, category, flagged step)."""
    p, kind, here = F.col("p"), F.col("kind"), F.col("step_index")
    tool, llm, retr = kind == "tool", kind == "llm", kind == "retriever"
    bad = F.coalesce(F.col("status") == "error", F.lit(False)) | F.coalesce(p["is_error"], F.lit(False))
    swallowed = F.when(F.col("kind_next") == "llm", F.col("claims_1")).otherwise(F.col("claims_2"))
    doc_terms = terms(F.array_join(F.transform(p["documents"], lambda d: F.coalesce(d["content_preview"], F.lit(""))), " "))
    return {
        "tool_error": (tool & p.isNotNull() & bad & ~F.lower(F.coalesce(p["tool_name"], F.lit(""))).eqNullSafe(BENIGN_TOOL), 0.70, "tool_failure_unhandled", here),
        "empty_tool_result": (tool & p.isNotNull() & (F.col("status") == "ok") & ~F.coalesce(p["is_error"], F.lit(False)) & F.col("empty"), 0.60, "silent_empty_result_misread", here),
        "error_swallowed": (tool & p.isNotNull() & (bad | F.col("empty")) & F.coalesce(swallowed, F.lit(False)), 0.85, "tool_failure_unhandled", here),
        "reasoning_turn_defect": ((kind == "agent") & p["output_text"].rlike(ASSUMING), 0.65, "information_fabrication", here),
        "context_overflow": (llm & (p["max_tokens"] > 0) & (p["total_tokens"] >= OVERFLOW * p["max_tokens"]), 0.60, "context_loss", here),
        "silent_history_truncation": (llm & (F.col("tokens_before") > 0) & (p["prompt_tokens"] <= TOKEN_DROP * F.col("tokens_before")) & (F.size(p["request_messages"]) >= F.col("messages_before")), 0.75, "context_loss", here),
        "tool_arg_malformed": (tool & (F.coalesce(p["arguments_json"], F.lit("")) != "") & F.try_parse_json(p["arguments_json"]).isNull(), 0.65, "malformed_tool_input", here),
        "output_schema_violation": (llm & p.isNotNull() & breaks_schema(p), 0.60, "output_schema_violation", here),
        "instruction_noncompliance": (llm & p.isNotNull() & (F.size(missing_literals(p["request_messages"], p["response_messages"])) > 0), 0.65, "constraint_violation", here),
        "premature_termination": (llm & F.col("kind_next").isNull() & F.contains("signature", F.lit("answer")) & (F.col("kind_before") != "tool"), 0.65, "premature_termination", F.col("index_before")),
        "missing_verification": ((F.col("outcome") == "failure") & (F.col("verified") == 0) & (here == F.col("first_refund")), 0.50, "missing_verification", here),
        "duplicate_delegation": ((kind == "agent") & (F.size(p["delegated_to"]) != F.size(F.array_distinct(p["delegated_to"]))), 0.55, "conflicting_subresults_unreconciled", here),
        "unused_retrieval": (retr & (F.size(p["documents"]) > 0) & F.col("next_request").isNotNull() & (F.size(doc_terms) > 0) & (F.size(F.array_intersect(doc_terms, terms(F.col("next_request")))) < COVERAGE * F.size(doc_terms)), 0.45, "retrieval_miss", here),
        "low_score_retrieval": (retr & (F.array_max(F.transform(p["documents"], lambda d: d["score"])) < LOW_SCORE), 0.50, "retrieval_miss", here),
        "goal_token_drift": (retr & (F.size(terms(F.col("task_goal"))) > 0) & (F.size(terms(p["query"])) > 0) & (F.size(F.array_intersect(terms(p["query"]), terms(F.col("task_goal")))) < COVERAGE * F.size(terms(p["query"]))), 0.45, "task_misinterpretation", here),
        "stall_timeout": ((F.col("median_ms") >= LEAST_MEDIAN_MS) & (F.col("duration_ms") >= STALL * F.col("median_ms")), 0.55, "unknown", here),
    }


ROW_DETECTORS = ["tool_error", "empty_tool_result", "error_swallowed", "instruction_noncompliance", "reasoning_turn_defect", "context_overflow", "silent_history_truncation", "tool_arg_malformed", "output_schema_violation", "premature_termination", "missing_verification", "duplicate_delegation", "unused_retrieval", "low_score_retrieval", "goal_token_drift", "stall_timeout"]


def _signal(df: DataFrame, name: str, severity: float, category: str, step: Column) -> DataFrame:
    return df.select("trace_id", step.cast("int").alias("step_index"), F.lit(name).alias("detector"), F.lit(severity).alias("severity"), F.lit(category).alias("category"))


def row_signals(enriched: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Signals of the row and window detectors, in one pass: every step emits an array of what fired on it."""
    pred = _predicates()
    fired = F.array(*(F.when(pred[n][0], F.struct(pred[n][3].cast("int").alias("step_index"), F.lit(n).alias("detector"), F.lit(pred[n][1]).alias("severity"), F.lit(pred[n][2]).alias("category"))) for n in names or ROW_DETECTORS))
    return wide(enriched).select("trace_id", F.explode(F.array_compact(fired)).alias("s")).select("trace_id", "s.step_index", "s.detector", "s.severity", "s.category")


def oscillation(enriched: DataFrame) -> DataFrame:
    """The first block of 2 to 4 tools, at least two of them different, that is at once repeated: shortest period first, then earliest start."""
    tools = enriched.where((F.col("kind") == "tool") & F.col("p.tool_name").isNotNull()).select("trace_id", "step_index", F.col("p.tool_name").alias("t"))
    ahead = tools.select("*", *(F.lead("t", i).over(by_step()).alias(f"t{i}") for i in range(1, 8)))
    at = lambda i: F.col("t") if i == 0 else F.col(f"t{i}")
    period = F.lit(None).cast("int")
    for n in (4, 3, 2):
        twice, differ = F.lit(True), F.lit(False)
        for i in range(n):
            twice = twice & F.coalesce(at(i) == at(i + n), F.lit(False))
            differ = differ | (at(i) != at(0))
        period = F.when(twice & differ, n).otherwise(period)
    first = ahead.select("trace_id", "step_index", period.alias("period")).where("period is not null").groupBy("trace_id").agg(F.min(F.struct("period", "step_index")).alias("f"))
    return _signal(first, "oscillation", 0.75, "infinite_loop_or_oscillation", F.col("f.step_index"))


def _tool_runs(enriched: DataFrame) -> DataFrame:
    """Runs of adjacent tool steps with the same tool and arguments."""
    key = F.when(F.col("kind") == "tool", F.concat_ws("|", F.coalesce("p.tool_name", F.lit("")), F.coalesce("p.arguments_json", F.lit(""))))
    s = enriched.select("trace_id", "step_index", key.alias("k"), F.coalesce("p.result_text", F.lit("")).alias("result"))
    s = s.select("*", F.when(F.col("k").isNull() | ~F.coalesce(F.lag("k").over(by_step()) == F.col("k"), F.lit(False)), 1).otherwise(0).alias("new"))
    s = s.select("*", F.sum("new").over(by_step()).alias("run")).where("k is not null")
    return s.groupBy("trace_id", "run").agg(F.min("step_index").alias("step_index"), F.count("*").alias("n"), F.count_distinct("result").alias("results")).where(F.col("n") >= LOOP_RUN)


def repeated_identical_action(enriched: DataFrame) -> DataFrame:
    return _signal(_tool_runs(enriched).where("results > 1"), "repeated_identical_action", 0.50, "infinite_loop_or_oscillation", F.col("step_index"))


def retry_storm(enriched: DataFrame) -> DataFrame:
    return _signal(_tool_runs(enriched).where("results = 1"), "retry_storm", 0.80, "infinite_loop_or_oscillation", F.col("step_index"))


def step_budget_exhausted(enriched: DataFrame) -> DataFrame:
    """Runs of LONG_RUN steps or more with one signature, flagged at the step before."""
    s = enriched.select("trace_id", "step_index", "signature", F.when(F.coalesce(F.lag("signature").over(by_step()) == F.col("signature"), F.lit(False)), 0).otherwise(1).alias("new"))
    runs = s.select("*", F.sum("new").over(by_step()).alias("run")).groupBy("trace_id", "run").agg(F.min("step_index").alias("first"), F.count("*").alias("n")).where(F.col("n") >= LONG_RUN)
    return _signal(runs, "step_budget_exhausted", 0.70, "step_budget_exhausted", F.greatest(F.col("first") - 1, F.lit(0)))


def hallucinated_tool(enriched: DataFrame) -> DataFrame:
    """Every tool call of a model step whose tool the trace never executes."""
    calls = enriched.where("kind = 'llm'").select("trace_id", "step_index", F.explode("p.tool_calls").alias("c")).select("trace_id", "step_index", F.col("c.tool_name").alias("tool")).where("tool is not null")
    run = enriched.where("kind = 'tool'").select(F.col("trace_id").alias("r_trace"), F.col("p.tool_name").alias("r_tool")).distinct()
    return _signal(calls.join(run, (F.col("trace_id") == F.col("r_trace")) & (F.col("tool") == F.col("r_tool")), "left_anti"), "hallucinated_tool", 0.80, "hallucinated_tool_or_parameter", F.col("step_index"))


def step_text(p: Column, kind: Column) -> Column:
    """What an identifier of a step may have been taken from, by kind; '' without a payload."""
    part = lambda c: F.coalesce(c, F.lit(""))
    previews = F.array_join(F.transform(p["documents"], lambda d: part(d["content_preview"])), " ")
    return part(
        F.when(kind == "tool", F.concat_ws(" ", part(p["result_text"]), part(p["arguments_json"])))
        .when(kind == "llm", F.concat_ws(" ", part(_text(p["request_messages"])), part(_text(p["response_messages"]))))
        .when(kind == "retriever", F.concat_ws(" ", part(p["query"]), part(previews)))
        .when(kind == "agent", F.concat_ws(" ", part(p["input_text"]), part(p["output_text"])))
    )


def argument_tokens(arguments: Column) -> Column:
    """Every identifier-shaped token (5 characters or more, a letter and a digit) of the string values of a JSON text, however deep."""
    quoted = r'"((?:[^"\\]|\\.)*)"(\s*:)?'
    names_too = F.arrays_zip(F.regexp_extract_all(arguments, F.lit(quoted), F.lit(1)).alias("x"), F.regexp_extract_all(arguments, F.lit(quoted), F.lit(2)).alias("colon"))
    strings = F.transform(F.filter(names_too, lambda z: z["colon"] == ""), lambda z: z["x"])
    plain = F.transform(strings, lambda x: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>"), F.lit(0)), x))
    return F.filter(F.flatten(F.transform(plain, lambda x: F.split(x, r"(?U)[\s,]+"))), lambda t: t.rlike(r"^[A-Za-z0-9_./:\-]{5,}$") & t.rlike("[A-Za-z]") & t.rlike("[0-9]"))


def parameter_drift(enriched: DataFrame) -> DataFrame:
    """Identifiers in a tool's arguments that stand neither in the goal nor in the text of any earlier step, not even inside a longer word. One signal an occurrence.

    A token can only lie inside one run of identifier characters. Runs with a digit are kept once a trace with their earliest step and
    meet the tokens on the five characters around the token's first digit, so no pair of steps is ever formed.
    """
    p, kind = F.col("p"), F.col("kind")
    uses = enriched.where("kind = 'tool' and p is not null and p.arguments_json is not null").where(F.try_parse_json("p.arguments_json").isNotNull()).select("trace_id", "step_index", F.explode(argument_tokens(p["arguments_json"])).alias("token"))
    uses = uses.select("trace_id", "step_index", F.lower("token").alias("token")).groupBy("trace_id", "step_index", "token").agg(F.count("*").cast("int").alias("times"))
    texts = enriched.select("trace_id", "step_index", step_text(p, kind).alias("t")).unionByName(enriched.groupBy("trace_id").agg(F.max("task_goal").alias("t")).select("trace_id", F.lit(-1).alias("step_index"), "t"))
    runs = texts.select("trace_id", "step_index", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"([a-z0-9_./:\-]{5,})"), F.lit(1)))).alias("run")).where(F.col("run").rlike("[0-9]"))
    runs = runs.groupBy("trace_id", "run").agg(F.min("step_index").alias("first"))
    grams = F.filter(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 4), lambda i: F.substring("run", i, F.lit(5)))), lambda g: g.rlike("[0-9]"))
    index = runs.select(F.col("trace_id").alias("f_trace"), "run", "first", F.explode(grams).alias("f_gram"))
    at = F.regexp_instr("token", F.lit("[0-9]"))
    keyed = uses.withColumn("gram", F.substring("token", F.greatest(F.lit(1), F.least(at - 2, F.length("token") - 4)), F.lit(5)))
    known = keyed.join(index, (F.col("trace_id") == F.col("f_trace")) & (F.col("gram") == F.col("f_gram")) & (F.col("first") < F.col("step_index")) & F.contains("run", "token"), "left_anti")
    return _signal(known.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times")))), "parameter_drift", 0.70, "hallucinated_tool_or_parameter", F.col("step_index"))


def broken_code(enriched: DataFrame) -> DataFrame:
    """The other half of reasoning_turn_defect: an agent's text that assumes nothing but has a code block that does not parse."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def breaks(texts: pa.Array) -> pa.Array:
        def bad(code: str) -> bool:
            try:
                ast.parse(code)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return True
            return False

        return pa.array([any(bad(c) for c in re.findall(CODE_BLOCK, t or "", re.S)) for t in texts.to_pylist()], pa.bool_())

    text = F.col("p.output_text")
    coded = enriched.where((F.col("kind") == "agent") & F.contains(text, F.lit("```")) & ~text.rlike(ASSUMING)).select("trace_id", "step_index", text.alias("text"))
    return _signal(coded.where(breaks("text")), "reasoning_turn_defect", 0.65, "malformed_tool_input", F.col("step_index"))


FRAME_DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (oscillation, repeated_identical_action, retry_storm, step_budget_exhausted, hallucinated_tool, parameter_drift)}
#: Registry order of all detectors.
DETECTORS = [*ROW_DETECTORS, *FRAME_DETECTORS]


def signals(enriched: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Signals of the named detectors (all by default)."""
    names = names or DETECTORS
    rows = [n for n in names if n in ROW_DETECTORS]
    parts = ([row_signals(enriched, rows)] if rows else []) + ([broken_code(enriched)] if "reasoning_turn_defect" in names else []) + [FRAME_DETECTORS[n](enriched) for n in names if n in FRAME_DETECTORS]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
