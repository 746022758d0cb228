"""Queries over the raw records: normalisation, ingestion and the cases that their annotations give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import linearize
from faultline.runtime import cut, table
from faultline.sources import cases, otlp, records, vocabularies

Query = Callable[[SparkSession, str], DataFrame]
_RAW = ["record_id", "trace_id", "span_id", "parent_span_id", "name", "attributes", "start_ns", "end_ns", "status_code", "status_message"]


def _normal(spark: SparkSession, d: str, layout: str) -> DataFrame:
    """The normalised spans of one layout with record_id and ord. Lists of ordinals become one sortable text."""
    rows = table(spark, d, "raw_records").where(F.col("layout") == layout)
    if layout == "openinference":
        raw = otlp.decode(rows, "body", "record_id").where("error is null").withColumn("ord", F.lit(""))
    else:
        raw = records.nested_spans(rows, "record_id", "body", layout == "trail").withColumn("ord", F.array_join(F.transform("ordinals", lambda i: F.lpad(i.cast("string"), 6, "0")), "."))
    return vocabularies.normalize(raw, ["record_id", "ord"])


def normalized_records(spark: SparkSession, d: str) -> DataFrame:
    """Every span of every body: vocabulary, kind, status and what its payload holds."""
    out = _normal(spark, d, "openinference").unionByName(_normal(spark, d, "raw_upload")).unionByName(_normal(spark, d, "trail"))
    p = F.col("p")
    return out.select(
        "record_id", "span_id", "vocabulary", "kind", "status", F.col("normalize_error").isNotNull().alias("failed"), p["tool_name"].alias("tool_name"), p["result_len"].alias("result_len"), p["is_error"].alias("is_error"), p["model"].alias("model"),
        p["prompt_tokens"].alias("prompt_tokens"), p["total_tokens"].alias("total_tokens"), F.size(p["request_messages"]).alias("request_messages"), F.size(p["documents"]).alias("documents"), p["query"].alias("query"), p["input_text"].alias("input_text"), p["agent_name"].alias("agent_name"),
    )


def ingested_traces(spark: SparkSession, d: str) -> DataFrame:
    """The headers of the traces that the direct uploads come to."""
    raw = table(spark, d, "raw_records").where("layout = 'raw_upload'")
    traces, _, _ = records.ingest(_normal(spark, d, "raw_upload"), records.upload_headers(raw, "body"))
    return traces.select("trace_id", "source", "framework", "task_goal", "outcome", "span_count", "step_count", F.size("orphan_span_ids").alias("orphans"), "task_key")


def agent_key(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of every trace's framework, actors and tools."""
    from faultline.operators.steps import distinct_steps, latest_traces

    return records.agent_keys(distinct_steps(table(spark, d, "steps")), latest_traces(table(spark, d, "traces")).select("trace_id", "framework"))


def task_key(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of every trace's goal."""
    from faultline.operators.steps import latest_traces

    return latest_traces(table(spark, d, "traces")).select("trace_id", records.masked_task_key(F.col("task_goal")).alias("task_key"))


def _trail(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(normalised spans, steps) of the trail records; a trace is one record, since traces are delivered again."""
    spans = _normal(spark, d, "trail").withColumn("trace_id", F.col("record_id").cast("string"))
    return cut(spans), cut(linearize.linearize(spans))


def benchmark_cases(spark: SparkSession, d: str) -> DataFrame:
    """The annotated errors of the trail records as cases with their true step, span and class."""
    raw = table(spark, d, "raw_records").where("layout = 'trail'")
    return cases.annotated_cases(raw, "record_id", "body", _trail(spark, d)[1])


QUERIES: dict[str, Query] = {f.__name__: f for f in (normalized_records, ingested_traces, agent_key, task_key, benchmark_cases)}

_BODIES = "select record_id, layout, json(ltrim(body, chr(65279))) j from raw_records where json_valid(ltrim(body, chr(65279)))"
_LIST = "case json_type({0}, '$.{1}') when 'ARRAY' then json_extract({0}, '$.{1}[*]') when 'OBJECT' then [json_extract({0}, '$.{1}')] else [] end"
_OI_KINDS = "case k when 'AGENT' then 'agent' when 'LLM' then 'llm' when 'TOOL' then 'tool' when 'RETRIEVER' then 'retriever' when 'CHAIN' then 'chain' when 'EMBEDDING' then 'embedding' when 'GUARDRAIL' then 'guardrail' else 'unknown' end"
_KNOWN = "('llm', 'tool', 'retriever', 'agent', 'chain', 'embedding', 'guardrail', 'unknown')"
_STATUS = "case {0} when 'STATUS_CODE_OK' then 'ok' when 'STATUS_CODE_ERROR' then 'error' else 'unset' end"
_ZONED = r"'\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?([Zz]|[+-]\d\d:?\d\d)'"

SQL: dict[str, str] = {
    "agent_key": """with st as (select trace_id, step_index, min(actor) actor, min(signature) signature from steps where trace_id is not null and step_index is not null group by all),
t as (select trace_id, framework from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last, outcome desc nulls last, task_goal desc nulls last, agent_key desc nulls last, task_key desc nulls last, framework desc nulls last) k from traces where trace_id is not null) where k = 1),
p as (select trace_id, actor, string_split(signature, ':') s from st),
k as (select trace_id, string_agg(distinct actor, ',' order by actor) actors, string_agg(distinct case when s[1] = 'tool' then s[3] when s[1] = 'llm' and s[3] = 'call' then s[4] end, ',' order by case when s[1] = 'tool' then s[3] when s[1] = 'llm' and s[3] = 'call' then s[4] end) tools from p group by trace_id)
select t.trace_id, sha1(coalesce(framework, '') || '|' || coalesce(actors, '') || '|' || coalesce(tools, '')) agent_key from t left join k using (trace_id)""",
    "task_key": r"""with t as (select trace_id, lower(coalesce(task_goal, '')) g from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last, outcome desc nulls last, task_goal desc nulls last) k from traces where trace_id is not null) where k = 1)
select trace_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(g, 'https?://\S+', '<url>', 'g'), '[\w.+-]+@[\w.-]+\.\w+', '<email>', 'g'), '\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '<uuid>', 'g'), '\b\d{4}-\d{2}-\d{2}\b', '<date>', 'g'), '\b\d+\b', '<int>', 'g'), '\s+', ' ', 'g'))) task_key from t""",
}


def _attribute(key: str) -> str:
    """The value of a key: of an OpenTelemetry span's list of pairs, of a flat object otherwise."""
    pair = f"list_filter({_LIST.format('n', 'attributes')}, lambda x: json_extract_string(x, '$.key') = '{key}')[-1]"
    return f"""case when layout = 'openinference' then coalesce({', '.join(f"json_extract_string({pair}, '$.value.{t}')" for t in ('stringValue', 'intValue', 'doubleValue', 'boolValue'))}) else json_extract_string(n, '$.span_attributes."{key}"') end"""


def _indexes(prefix: str) -> str:
    """How many indexes the flattened keys of a prefix have."""
    keys = f"case when layout = 'openinference' then list_transform({_LIST.format('n', 'attributes')}, lambda x: json_extract_string(x, '$.key')) else json_keys(n, '$.span_attributes') end"
    pattern = "^" + prefix.replace(".", r"\.") + r"\.(\d+)\..+$"
    return rf"len(list_distinct(list_transform(list_filter({keys}, lambda k: regexp_matches(k, '{pattern}')), lambda k: regexp_extract(k, '{pattern}', 1))))"


_NODES = f"""
with recursive bodies as ({_BODIES}),
r as (select record_id, layout, unnest({_LIST.format('j', 'resourceSpans')}) n from bodies where layout = 'openinference'),
s as (select record_id, layout, unnest({_LIST.format('n', 'scopeSpans')}) n from r),
tree(record_id, layout, n) as (select record_id, layout, unnest({_LIST.format('j', 'spans')}) from bodies where layout = 'trail' union all select record_id, layout, unnest({_LIST.format('n', 'child_spans')}) from tree),
nodes as (select record_id, layout, unnest({_LIST.format('n', 'spans')}) n from s union all select record_id, layout, unnest({_LIST.format('j', 'spans')}) from bodies where layout = 'raw_upload' union all select * from tree)"""
_U = "json_extract_string(n, '$.attributes.\"{0}\"')"
SQL["normalized_records"] = _NODES + f""",
oi as (select record_id, coalesce(json_extract_string(n, '$.spanId'), json_extract_string(n, '$.span_id')) span_id, {_attribute('openinference.span.kind')} k, coalesce(json_extract_string(n, '$.status.code'), 'STATUS_CODE_' || upper(json_extract_string(n, '$.status_code'))) code,
  case when layout = 'trail' then regexp_full_match(coalesce(json_extract_string(n, '$.timestamp'), ''), {_ZONED}) and (json_extract_string(n, '$.duration') is null or regexp_full_match(json_extract_string(n, '$.duration'), 'PT([0-9.]+H)?([0-9.]+M)?([0-9.]+S)?'))
   else regexp_full_match(coalesce(json_extract_string(n, '$.startTimeUnixNano'), ''), '\\d+') and regexp_full_match(coalesce(json_extract_string(n, '$.endTimeUnixNano'), ''), '\\d+') end timed,
  {_attribute('tool.name')} tool, {_attribute('output.value')} res, {_attribute('llm.model_name')} model, {_attribute('llm.token_count.prompt')} pt, {_attribute('llm.token_count.total')} tt, {_attribute('input.value')} inp, {_attribute('metadata')} meta, {_attribute('llm.invocation_parameters')} par,
  {_indexes('llm.input_messages')} msgs, {_indexes('retrieval.documents')} docs from nodes where layout <> 'raw_upload' and json_type(n) = 'OBJECT'),
oj as (select *, case when k is null then 'unknown' else 'openinference' end vocabulary, {_OI_KINDS} kind, {_STATUS.format('code')} status from oi),
ok as (select *, k is null or span_id is null or not timed or (kind = 'llm' and par is not null and not json_valid(par)) or (kind = 'agent' and meta is not null and not json_valid(meta)) failed from oj),
up as (select record_id, json_extract_string(n, '$.span_id') span_id, json_extract_string(n, '$.kind') k, json_extract_string(n, '$.status') st, json_extract_string(n, '$.start_time') b, json_extract_string(n, '$.end_time') e, json_extract_string(n, '$.actor') actor, n from nodes where layout = 'raw_upload' and json_type(n) = 'OBJECT'),
uq as (select *, case when coalesce(k in {_KNOWN}, false) and b is not null and e is not null then 'raw_upload' else 'unknown' end vocabulary from up),
ur as (select *, vocabulary = 'unknown' or span_id is null or coalesce(st, 'unset') not in ('ok', 'error', 'unset') or not regexp_full_match(b, {_ZONED}) or not regexp_full_match(e, {_ZONED}) failed from uq)
select record_id, coalesce(span_id, '') span_id, vocabulary, case when failed then 'unknown' else kind end kind, status, failed,
 case when not failed and kind = 'tool' then coalesce(tool, 'unknown') end tool_name, case when not failed and kind = 'tool' then length(coalesce(res, '')) end result_len, case when not failed and kind = 'tool' then status = 'error' end is_error,
 case when not failed and kind = 'llm' then coalesce(model, 'unknown') end model, case when not failed and kind = 'llm' then try_cast(pt as bigint) end prompt_tokens, case when not failed and kind = 'llm' then try_cast(tt as bigint) end total_tokens,
 case when not failed and kind = 'llm' then msgs end request_messages, case when not failed and kind = 'retriever' then docs end documents, case when not failed and kind = 'retriever' then coalesce(inp, '') end query, case when not failed and kind = 'agent' then coalesce(inp, '') end input_text,
 case when not failed and kind = 'agent' then coalesce(json_extract_string(meta, '$.agent_name'), 'unknown') end agent_name from ok
union all select record_id, coalesce(span_id, ''), vocabulary, case when failed then 'unknown' else k end, case when failed then 'unset' else coalesce(st, 'unset') end, failed,
 case when not failed and k = 'tool' then coalesce({_U.format('tool_name')}, 'unknown') end, case when not failed and k = 'tool' then length(coalesce({_U.format('result')}, '')) end, case when not failed and k = 'tool' then coalesce({_U.format('is_error')}, 'false') = 'true' end,
 case when not failed and k = 'llm' then coalesce({_U.format('model')}, 'unknown') end, case when not failed and k = 'llm' then try_cast({_U.format('prompt_tokens')} as bigint) end, case when not failed and k = 'llm' then try_cast({_U.format('prompt_tokens')} as bigint) + try_cast({_U.format('completion_tokens')} as bigint) end,
 case when not failed and k = 'llm' then len(list_filter(coalesce(case json_type(n, '$.attributes.request_messages') when 'OBJECT' then [json_extract(n, '$.attributes.request_messages')] else json_extract(n, '$.attributes.request_messages[*]') end, []), lambda m: json_type(m) <> 'NULL')) end,
 case when not failed and k = 'retriever' then len(list_filter(coalesce(case json_type(n, '$.attributes.documents') when 'OBJECT' then [json_extract(n, '$.attributes.documents')] else json_extract(n, '$.attributes.documents[*]') end, []), lambda m: json_type(m) <> 'NULL')) end,
 case when not failed and k = 'retriever' then coalesce({_U.format('query')}, '') end, case when not failed and k = 'agent' then coalesce({_U.format('input_text')}, '') end, case when not failed and k = 'agent' then coalesce({_U.format('agent.name')}, actor, 'unknown') end from ur"""
