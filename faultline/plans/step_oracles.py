"""Equivalent SQL of the detectors, for the driver's comparison on the same tables."""

from __future__ import annotations

from faultline.operators import detectors

BASE = """
with st as (select trace_id, step_index, min(span_id) span_id, min(kind) kind, min(actor) actor, min(signature) signature, min(duration_ms) duration_ms
            from steps where trace_id is not null and step_index is not null group by 1, 2),
sp as (select trace_id, span_id, min(status) status, min(payload) payload from spans where trace_id is not null and span_id is not null group by 1, 2),
tr as (select trace_id, outcome, task_goal from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last, outcome desc nulls last, task_goal desc nulls last) rn from traces) where rn = 1),
e as (select st.*, sp.status, sp.payload p, tr.outcome, tr.task_goal from st left join sp using (trace_id, span_id) left join tr using (trace_id)),
x as (select *, json_extract_string(p, '$.tool_name') tool_name, json_extract_string(p, '$.arguments_json') arguments_json, json_extract_string(p, '$.result_text') result_text,
      coalesce(cast(json_extract_string(p, '$.is_error') as boolean), false) is_error, cast(json_extract_string(p, '$.result_len') as bigint) result_len,
      cast(json_extract_string(p, '$.prompt_tokens') as bigint) prompt_tokens, cast(json_extract_string(p, '$.total_tokens') as bigint) total_tokens, cast(json_extract_string(p, '$.max_tokens') as bigint) max_tokens,
      json_array_length(p, '$.request_messages') n_messages,
      (coalesce(cast(json_extract_string(p, '$.result_len') as bigint) = 0, false) or lower(trim(coalesce(json_extract_string(p, '$.result_text'), ''))) in ('', '[]', '{}', 'null', 'no results found')) is_empty,
      lower(array_to_string(list_transform(json_extract_string(p, '$.response_messages[*].content'), lambda c: coalesce(c, '')), ' ')) answer,
      array_to_string(list_transform(json_extract_string(p, '$.request_messages[*].content'), lambda c: coalesce(c, '')), ' ') asked
      from e)
"""


def _signal(name: str, severity: float, category: str, step: str = "step_index") -> str:
    return f"select trace_id, cast({step} as integer) step_index, '{name}' detector, cast({severity} as double) severity, '{category}' category"


BAD = "(coalesce(status = 'error', false) or is_error)"
_holds = lambda words: " or ".join("contains(coalesce(answer, ''), '" + w.replace("'", "''") + "')" for w in words)
_FAIL, _GOOD = _holds(detectors.FAILURE_WORDS), _holds(detectors.SUCCESS_WORDS)
_QUERY = "json_extract_string(p, '$.query')"
_TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"

SQL: dict[str, str] = {
    "tool_error": BASE + _signal("tool_error", 0.7, "tool_failure_unhandled") + f" from x where kind = 'tool' and p is not null and {BAD} and lower(coalesce(tool_name, '')) <> 'execution_result'",
    "empty_tool_result": BASE + _signal("empty_tool_result", 0.6, "silent_empty_result_misread") + " from x where kind = 'tool' and p is not null and status = 'ok' and not is_error and is_empty",
    "error_swallowed": BASE + f""", y as (select *, case when kind = 'llm' then (not ({_FAIL})) and ({_GOOD}) end claims from x),
z as (select *, lead(kind) over w k1, lead(claims) over w c1, lead(claims, 2) over w c2 from y window w as (partition by trace_id order by step_index))
""" + _signal("error_swallowed", 0.85, "tool_failure_unhandled") + f" from z where kind = 'tool' and p is not null and ({BAD} or is_empty) and coalesce(case when k1 = 'llm' then c1 else c2 end, false)",
    "context_overflow": BASE + _signal("context_overflow", 0.6, "context_loss") + " from x where kind = 'llm' and max_tokens > 0 and total_tokens >= 0.9::double * max_tokens",
    "silent_history_truncation": BASE + """, y as (select *, lag(prompt_tokens) over w tb, lag(n_messages) over w nb from x window w as (partition by trace_id, actor, kind order by step_index))
""" + _signal("silent_history_truncation", 0.75, "context_loss") + " from y where kind = 'llm' and tb > 0 and prompt_tokens <= 0.7::double * tb and n_messages >= nb",
    "tool_arg_malformed": BASE + _signal("tool_arg_malformed", 0.65, "malformed_tool_input") + " from x where kind = 'tool' and coalesce(arguments_json, '') <> '' and not json_valid(arguments_json)",
    "premature_termination": BASE + """, y as (select *, lead(kind) over w k1, lag(kind) over w kb, lag(step_index) over w ib from x window w as (partition by trace_id order by step_index))
""" + _signal("premature_termination", 0.65, "premature_termination", "ib") + " from y where kind = 'llm' and k1 is null and contains(signature, 'answer') and kb <> 'tool'",
    "missing_verification": BASE + """, y as (select *, max(case when contains(signature, 'verify_eligibility') then 1 else 0 end) over (partition by trace_id) verified, min(case when kind = 'tool' and contains(signature, 'process_refund') then step_index end) over (partition by trace_id) fr from x)
""" + _signal("missing_verification", 0.5, "missing_verification") + " from y where outcome = 'failure' and verified = 0 and step_index = fr",
    "duplicate_delegation": BASE + _signal("duplicate_delegation", 0.55, "conflicting_subresults_unreconciled") + " from x where kind = 'agent' and json_array_length(p, '$.delegated_to') <> len(list_distinct(json_extract_string(p, '$.delegated_to[*]')))",
    "low_score_retrieval": BASE + _signal("low_score_retrieval", 0.5, "retrieval_miss") + " from x where kind = 'retriever' and list_max(list_transform(json_extract_string(p, '$.documents[*].score'), lambda s: cast(s as double))) < 0.3",
    "goal_token_drift": BASE + f", y as (select *, {_TERMS.format('task_goal')} g, {_TERMS.format(_QUERY)} q from x) " + _signal("goal_token_drift", 0.45, "task_misinterpretation") + " from y where kind = 'retriever' and len(g) > 0 and len(q) > 0 and len(list_intersect(q, g)) < 0.15::double * len(q)",
    "stall_timeout": BASE + ", y as (select *, median(duration_ms) over (partition by trace_id, kind) med from x) " + _signal("stall_timeout", 0.55, "unknown") + " from y where med >= 1 and duration_ms >= 5 * med",
    "oscillation": BASE + """, t as (select trace_id, step_index, tool_name t0, lead(tool_name, 1) over w t1, lead(tool_name, 2) over w t2, lead(tool_name, 3) over w t3, lead(tool_name, 4) over w t4, lead(tool_name, 5) over w t5, lead(tool_name, 6) over w t6, lead(tool_name, 7) over w t7
 from x where kind = 'tool' and tool_name is not null window w as (partition by trace_id order by step_index)),
u as (select trace_id, step_index, case when t0 = t2 and t1 = t3 and t0 <> t1 then 2 when t0 = t3 and t1 = t4 and t2 = t5 and (t1 <> t0 or t2 <> t0) then 3 when t0 = t4 and t1 = t5 and t2 = t6 and t3 = t7 and (t1 <> t0 or t2 <> t0 or t3 <> t0) then 4 end period from t),
f as (select *, row_number() over (partition by trace_id order by period, step_index) rn from u where period is not null)
""" + _signal("oscillation", 0.75, "infinite_loop_or_oscillation") + " from f where rn = 1",
    "step_budget_exhausted": BASE + """, r as (select *, case when lag(signature) over w = signature then 0 else 1 end n from x window w as (partition by trace_id order by step_index)),
g as (select *, sum(n) over (partition by trace_id order by step_index) run from r), h as (select trace_id, run, greatest(min(step_index) - 1, 0) s from g group by 1, 2 having count(*) >= 10)
""" + _signal("step_budget_exhausted", 0.7, "step_budget_exhausted", "s") + " from h",
    "hallucinated_tool": BASE + """, c as (select trace_id, step_index, unnest(json_extract_string(p, '$.tool_calls[*].tool_name')) tool from x where kind = 'llm')
""" + _signal("hallucinated_tool", 0.8, "hallucinated_tool_or_parameter") + " from c where tool is not null and not exists (select 1 from x where x.trace_id = c.trace_id and x.kind = 'tool' and x.tool_name = c.tool)",
}
_RUNS = BASE + """, k as (select *, case when kind = 'tool' then coalesce(tool_name, '') || '|' || coalesce(arguments_json, '') end key from x),
r as (select *, case when key is not null and lag(key) over w = key then 0 else 1 end n from k window w as (partition by trace_id order by step_index)),
g as (select *, sum(n) over (partition by trace_id order by step_index) run from r),
h as (select trace_id, run, min(step_index) step_index, count(distinct coalesce(result_text, '')) results from g where key is not null group by 1, 2 having count(*) >= 3)
"""  # fmt: skip
SQL["repeated_identical_action"] = _RUNS + _signal("repeated_identical_action", 0.5, "infinite_loop_or_oscillation") + " from h where results > 1"
SQL["retry_storm"] = _RUNS + _signal("retry_storm", 0.8, "infinite_loop_or_oscillation") + " from h where results = 1"
SQL["unused_retrieval"] = BASE + f""", y as (select *, first_value(case when kind = 'llm' then asked end ignore nulls) over (partition by trace_id order by step_index rows between 1 following and unbounded following) nxt,
 array_to_string(list_transform(json_extract_string(p, '$.documents[*].content_preview'), lambda c: coalesce(c, '')), ' ') doc from x),
z as (select *, {_TERMS.format('doc')} d, {_TERMS.format('nxt')} a from y)
""" + _signal("unused_retrieval", 0.45, "retrieval_miss") + " from z where kind = 'retriever' and json_array_length(p, '$.documents') > 0 and nxt is not null and len(d) > 0 and len(list_intersect(d, a)) < 0.15::double * len(d)"  # fmt: skip
_ASSUMING = detectors.ASSUMING.replace("'", "''")
SQL["reasoning_turn_defect"] = BASE + _signal("reasoning_turn_defect", 0.65, "information_fabrication") + f" from x where kind = 'agent' and regexp_matches(coalesce(json_extract_string(p, '$.output_text'), ''), '{_ASSUMING}')"
SQL["output_schema_violation"] = BASE + """, y as (select *, json_extract_string(p, '$.response_format_schema') sch, list_filter(json_extract_string(p, '$.response_messages[*].content'), lambda c: coalesce(c, '') <> '')[1] txt from x where kind = 'llm' and p is not null)
""" + _signal("output_schema_violation", 0.6, "output_schema_violation") + """ from y where replace(coalesce(sch, ''), ' ', '') not in ('', '{}', 'null')
 and not coalesce(case when json_valid(txt) and json_type(txt) = 'OBJECT' then len(list_filter(coalesce(case when json_valid(sch) then json_extract_string(sch, '$.required[*]') end, []), lambda k: not list_contains(json_keys(txt), k))) = 0 end, false)"""
_DEMAND = detectors.DEMAND.replace("'", "''")
_NOISE = ", ".join(f"'{x}'" for x in detectors.HTML_NOISE)
SQL["instruction_noncompliance"] = BASE + f""", m as (select *, list_filter(json_extract(p, '$.request_messages[*]'), lambda z: json_extract_string(z, '$.role') = 'system')[1] sy, list_filter(json_extract(p, '$.request_messages[*]'), lambda z: json_extract_string(z, '$.role') = 'user')[1] us from x where kind = 'llm' and p is not null),
y as (select *, coalesce(json_extract_string(sy, '$.content'), '') || chr(10) || coalesce(json_extract_string(us, '$.content'), '') told from m),
l as (select trace_id, step_index, answer, unnest(list_concat(regexp_extract_all(told, '{_DEMAND}', 1), regexp_extract_all(told, '{_DEMAND}', 2), regexp_extract_all(told, '{_DEMAND}', 3), regexp_extract_all(told, '{_DEMAND}', 4), regexp_extract_all(told, '{_DEMAND}', 5))) lit from y),
z as (select distinct trace_id, step_index from l where coalesce(lit, '') <> '' and lower(lit) not in ({_NOISE}) and not contains(coalesce(answer, ''), lower(lit)))
""" + _signal("instruction_noncompliance", 0.65, "constraint_violation") + " from z"
SQL["parameter_drift"] = BASE + """, said as (select trace_id, step_index, lower(case kind when 'tool' then concat(result_text, ' ', arguments_json) when 'llm' then concat(asked, ' ', answer) when 'retriever' then concat(json_extract_string(p, '$.query'), ' ', array_to_string(list_transform(json_extract_string(p, '$.documents[*].content_preview'), lambda c: coalesce(c, '')), ' '))
 when 'agent' then concat(json_extract_string(p, '$.input_text'), ' ', json_extract_string(p, '$.output_text')) end) t from x union all select trace_id, -1, lower(max(task_goal)) from x group by trace_id),
us as (select trace_id, step_index, unnest(list_filter(flatten(list_transform(list_filter(json_extract_string(arguments_json, '$.**'), lambda v: v is not null and not starts_with(v, '{') and not starts_with(v, '[')), lambda v: string_split_regex(v, '[\\s,]+'))), lambda w: regexp_full_match(w, '[A-Za-z0-9_./:\\-]{5,}') and regexp_matches(w, '[A-Za-z]') and regexp_matches(w, '[0-9]'))) token from x where kind = 'tool' and p is not null and json_valid(arguments_json))
""" + _signal("parameter_drift", 0.7, "hallucinated_tool_or_parameter") + " from us where not exists (select 1 from said where said.trace_id = us.trace_id and said.step_index < us.step_index and contains(said.t, lower(us.token)))"
#: All of them, in no order.
ALL = " union all ".join(f"select * from ({q})" for q in SQL.values())
