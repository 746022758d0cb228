"""The step table that every detector shares: distinct steps with the payload of their span and the outcome of their trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One struct holds the fields of all four payload kinds, so that Catalyst prunes what a query does not use.
PAYLOAD = (
    "tool_name string, arguments_json string, result_text string, result_len bigint, is_error boolean, error_message string, provider string, model string, "
    "request_messages array<struct<role string, content string>>, response_messages array<struct<role string, content string>>, tool_calls array<struct<tool_name string, arguments_json string>>, "
    "finish_reason string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, max_tokens bigint, temperature double, response_format_schema string, "
    "query string, documents array<struct<doc_id string, content_len bigint, content_preview string, score double>>, top_k bigint, agent_name string, role string, input_text string, output_text string, delegated_to array<string>"
)
#: Tool results that say nothing (fixed values).
EMPTY_RESULTS = ["", "[]", "{}", "null", "no results found"]


def distinct_steps(steps: DataFrame) -> DataFrame:
    """One row per (trace_id, step_index); of repeated rows the smallest value of each column counts. Rows without a key are left out."""
    cols = ["span_id", "kind", "actor", "signature", "summary", "depth", "start_ns", "end_ns", "duration_ms"]
    return steps.where("trace_id is not null and step_index is not null").groupBy("trace_id", "step_index").agg(*(F.min(c).alias(c) for c in cols))


def distinct_spans(spans: DataFrame) -> DataFrame:
    """One row per (trace_id, span_id) with status, payload and attributes."""
    return spans.where("trace_id is not null and span_id is not null").groupBy("trace_id", "span_id").agg(F.min("status").alias("status"), F.min("payload").alias("payload"), F.min("start_ns").alias("span_start_ns"))


def latest_traces(traces: DataFrame) -> DataFrame:
    """The latest row of every trace: trace_id, outcome, task_goal, agent_key, task_key, framework, source."""
    cols = ["outcome", "task_goal", "agent_key", "task_key", "framework", "source", "root_span_id"]
    last = F.max(F.struct("ingested_at", *cols))
    return traces.where("trace_id is not null").groupBy("trace_id").agg(last.alias("r")).select("trace_id", *(F.col(f"r.{c}").alias(c) for c in cols))


def strip(col: Column) -> Column:
    """A text without outer white space of any kind."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def enrich(steps: DataFrame, spans: DataFrame, traces: DataFrame) -> DataFrame:
    """Distinct steps with status, p (the payload struct, null without one), outcome and task_goal. One shuffle on trace_id and span_id joins the spans."""
    s = distinct_spans(spans).select(F.col("trace_id").alias("sp_trace"), F.col("span_id").alias("sp_id"), "status", F.from_json("payload", PAYLOAD).alias("p"))
    t = latest_traces(traces).select(F.col("trace_id").alias("tr_trace"), "outcome", "task_goal")
    d = distinct_steps(steps)
    return d.join(s, (d["trace_id"] == s["sp_trace"]) & (d["span_id"] == s["sp_id"]), "left").join(t, d["trace_id"] == t["tr_trace"], "left").drop("sp_trace", "sp_id", "tr_trace")


def is_empty_result() -> Column:
    p = F.col("p")
    return F.coalesce(p["result_len"] == 0, F.lit(False)) | F.lower(strip(F.coalesce(p["result_text"], F.lit("")))).isin(*EMPTY_RESULTS)


def terms(col: Column) -> Column:
    """The distinct words of a text; null for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9]+)"), 1))
