"""Relational operators of the engine as declarative plans over the trace tables.

Each plan is one SELECT over named relations. ``run`` gives it to Catalyst with the relations bound to data
frames; ``duck`` spells the same plan for the driver's comparison. What the two dialects write differently
stands between bars: |json a b| takes field b of JSON text a, |long x| casts, |re a p| tests, |sub a p r| replaces all.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from faultline.operators import detectors, steps
from faultline.runtime import cut, table

_MARK = re.compile(r"\|(\w+) ([^|]*)\|")


def _spark(m: re.Match) -> str:
    a = m[2].split(" ~ ")
    return {
        "json": lambda: f"get_json_object({a[0]}, '$.{a[1]}')", "re": lambda: f"({a[0]} rlike '{a[1]}')", "sub": lambda: f"regexp_replace({a[0]}, '{a[1]}', '{a[2]}')",
        "words": lambda: f"array_distinct(regexp_extract_all(lower({a[0]}), '([a-z0-9]+)', 1))", "size": lambda: f"size({a[0]})", "joined": lambda: f"array_join(array_sort(collect_set({a[0]})), ',')",
        "part": lambda: f"coalesce(try_element_at(split({a[0]}, ':'), {a[1]}), '')", "cosine": lambda: f"(aggregate(zip_with({a[0]}, {a[1]}, (x, y) -> cast(x as double) * y), cast(0 as double), (s, x) -> s + x) / sqrt(aggregate({a[0]}, cast(0 as double), (s, x) -> s + cast(x as double) * x)) / sqrt(aggregate({a[1]}, cast(0 as double), (s, x) -> s + cast(x as double) * x)))",
        "micros": lambda: f"unix_micros({a[0]})", "bround": lambda: f"cast(bround({a[0]}) as int)", "tail": lambda: f"right({a[0]}, {a[1]})", "at": lambda: f"element_at({a[0]}, {a[1]})", "nulls": lambda: f"{a[0]} is null", "inlist": lambda: f"array_contains({a[0]}, {a[1]})",
    }[m[1]]()


def _duck(m: re.Match) -> str:
    a = m[2].split(" ~ ")
    return {
        "json": lambda: f"json_extract_string({a[0]}, '$.{a[1]}')", "re": lambda: f"regexp_matches({a[0]}, '{a[1]}')", "sub": lambda: f"regexp_replace({a[0]}, '{a[1]}', '{a[2]}', 'g')",
        "words": lambda: f"list_distinct(regexp_extract_all(lower({a[0]}), '[a-z0-9]+'))", "size": lambda: f"len({a[0]})", "joined": lambda: f"array_to_string(list_sort(list_distinct(list({a[0]}) filter (where {a[0]} is not null))), ',')",
        "part": lambda: f"split_part({a[0]}, ':', {a[1]})", "cosine": lambda: f"list_cosine_similarity({a[0]}::double[], {a[1]}::double[])",
        "micros": lambda: f"epoch_us({a[0]})", "bround": lambda: f"cast(round_even({a[0]}, 0) as int)", "tail": lambda: f"right({a[0]}, {a[1]})", "at": lambda: f"{a[0]}[{a[1]}]", "nulls": lambda: f"{a[0]} is null", "inlist": lambda: f"list_contains({a[0]}, {a[1]})",
    }[m[1]]()


TABLES = ["traces", "spans", "steps", "diagnoses", "divergences", "clusters", "documents", "events", "raw_records", "embeddings"]


def run(spark: SparkSession, sf_dir: str, plan: str) -> DataFrame:
    """The plan over the tables of a folder."""
    text = _MARK.sub(_spark, plan)
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
    return spark.sql(re.sub(r"(\bfrom|\bjoin) (" + "|".join(TABLES) + r")\b", r"\1 {\2}", text), **used)


def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of all detectors, written once, as plans read them more than once."""
    return cut(detectors.signals(steps.enrich(*(table(spark, sf_dir, t) for t in ("steps", "spans", "traces")))))


def duck(plan: str) -> str:
    """The plan as SQL over tables of the same names."""
    return _MARK.sub(_duck, plan)


STEPS = """st as (select trace_id, step_index, min(span_id) span_id, min(kind) kind, min(actor) actor, min(signature) signature, min(depth) depth, min(duration_ms) duration_ms, min(start_ns) start_ns, min(end_ns) end_ns, min(summary) summary
 from steps where trace_id is not null and step_index is not null group by trace_id, step_index)"""
SPANS = """sp as (select trace_id, span_id, min(parent_span_id) parent_span_id, min(kind) kind, min(status) status, min(payload) payload, min(start_ns) start_ns from spans where trace_id is not null and span_id is not null group by trace_id, span_id)"""
TRACES = """tr as (select trace_id, outcome, task_goal, agent_key, task_key, framework, source, span_count, step_count, ingested_at from (select *, row_number() over (partition by trace_id order by ingested_at desc nulls last, outcome desc nulls last, task_goal desc nulls last, span_count desc nulls last, step_count desc nulls last) rn from traces) q where rn = 1)"""
DIAG = """dg as (select diagnosis_id, trace_id, root_cause_step_index, root_cause_span_id, failure_class, confidence, calibrated_confidence, abstained, abstain_reason, rationale, candidates_considered, cluster_id from (select *, row_number() over (partition by diagnosis_id order by created_at desc nulls last, confidence desc nulls last, cluster_id desc nulls last) rn from diagnoses) q where rn = 1)"""
DIV = """dv as (select diagnosis_id, step_index, min(trace_id) trace_id, min(span_id) span_id, min(divergence_score) score, min(cliff_delta) cliff, min(surprisal) surprisal, min(profile_surprisal) profile_surprisal, min(observed_signature) observed_signature, min(alignment_op) alignment_op
 from divergences where diagnosis_id is not null and step_index is not null group by diagnosis_id, step_index)"""
PLANS: dict[str, str] = {
    # ingestion
    "ingest_counts": f"with {SPANS}, {STEPS}, {TRACES}, a as (select trace_id, count(*) n from sp group by trace_id), b as (select trace_id, count(*) n from st group by trace_id) select tr.trace_id, coalesce(a.n, 0) spans, coalesce(b.n, 0) steps, coalesce(a.n, 0) <> coalesce(tr.span_count, -1) spans_stale, coalesce(b.n, 0) <> coalesce(tr.step_count, -1) steps_stale from tr left join a on tr.trace_id = a.trace_id left join b on tr.trace_id = b.trace_id",
    "outcome_inference": f"with {SPANS} select trace_id, case when max(case when status = 'error' then 1 else 0 end) = 1 then 'failure' else 'success' end inferred_outcome, count(*) spans from sp group by trace_id",
    "task_goal_first_user": f"with {SPANS}, f as (select trace_id, |json payload ~ input_text| goal, row_number() over (partition by trace_id order by start_ns, span_id) rn from sp where kind = 'agent' and coalesce(|json payload ~ input_text|, '') <> '') select trace_id, goal from f where rn = 1",
    "latest_traces": f"with {TRACES} select trace_id, outcome, source, framework from tr",
    "status_rollup": f"with {SPANS} select kind, status, count(*) spans from sp group by grouping sets ((kind, status), (kind), ())",
    # steps
    "step_context": f"with {STEPS}, {DIAG} select dg.diagnosis_id, st.step_index, st.kind, st.signature, st.summary from dg join st on dg.trace_id = st.trace_id and st.step_index between dg.root_cause_step_index - 1 and dg.root_cause_step_index + 1",
    "next_llm": f"with {STEPS} select trace_id, step_index, min(case when kind = 'llm' then step_index end) over (partition by trace_id order by step_index rows between 1 following and unbounded following) next_llm from st",
    "signature_runs": f"with {STEPS}, r as (select *, case when lag(signature) over (partition by trace_id order by step_index) = signature then 0 else 1 end fresh from st), g as (select *, sum(fresh) over (partition by trace_id order by step_index) run from r) select trace_id, min(step_index) start_step_index, count(*) run_length, min(signature) signature from g group by trace_id, run",
    "step_outcomes": f"with {STEPS} select actor, kind, |part lower(signature) ~ 4| outcome_token, count(*) steps from st where |re signature ~ ^[a-zA-Z_]+:[^:]+:[^:]+:[^:]+$| group by actor, kind, |part lower(signature) ~ 4|",
    # reference model
    "markov_transitions": f"with {STEPS}, {TRACES}, b as (select st.trace_id, st.signature, lag(st.signature) over (partition by st.trace_id order by st.step_index) prev from st join tr on st.trace_id = tr.trace_id where tr.outcome = 'success') select coalesce(prev, '<start>') previous_signature, signature, count(*) n from b group by coalesce(prev, '<start>'), signature",
    "markov_surprisal": f"with {STEPS}, {TRACES}, a as (select st.trace_id, st.step_index, tr.outcome, st.signature, coalesce(lag(st.signature) over (partition by st.trace_id order by st.step_index), '<start>') prev from st join tr on st.trace_id = tr.trace_id), b as (select prev, signature, count(*) c from a where outcome = 'success' group by prev, signature), p as (select prev, sum(c) t from b group by prev), v as (select count(distinct signature) v from a where outcome = 'success') select a.trace_id, a.step_index, round(-ln((coalesce(b.c, 0) + cast(0.5 as double)) / (coalesce(p.t, 0) + cast(0.5 as double) * (v.v + 1))), 6) surprisal from a cross join v left join b on a.prev = b.prev and a.signature = b.signature left join p on a.prev = p.prev where a.outcome = 'failure'",
    "count_envelopes": f"with {STEPS}, {TRACES}, n as (select tr.agent_key, st.trace_id, count(*) steps from st join tr on st.trace_id = tr.trace_id where tr.outcome = 'success' and tr.agent_key is not null group by tr.agent_key, st.trace_id), m as (select agent_key, median(steps) med from n group by agent_key) select n.agent_key, max(m.med) median_steps, median(abs(n.steps - m.med)) mad_steps, count(*) runs from n join m on n.agent_key = m.agent_key group by n.agent_key",
    "profile_top": f"with {STEPS}, {TRACES}, c as (select tr.agent_key, st.step_index, st.signature, count(*) n from st join tr on st.trace_id = tr.trace_id where tr.outcome = 'success' and tr.agent_key is not null group by tr.agent_key, st.step_index, st.signature), r as (select *, row_number() over (partition by agent_key, step_index order by n desc, signature) k, sum(n) over (partition by agent_key, step_index) total, count(*) over (partition by agent_key, step_index) kinds from c) select agent_key, step_index, signature, k rank_in_column, round((n + cast(0.5 as double)) / (total + cast(0.5 as double) * kinds), 6) probability from r where k <= 3",
    "norm_minmax": f"with {DIV} select diagnosis_id, step_index, round(case when max(score) over w - min(score) over w < 1e-9 then cast(0 as double) else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 6) normed from dv window w as (partition by diagnosis_id)",
    "cliff_windows": f"with {DIV} select diagnosis_id, step_index, round(greatest(cast(0 as double), lead(score) over (partition by diagnosis_id order by step_index) - score), 6) cliff from dv",
    "gate_eligible": f"with {DIV}, g as (select *, max(score) over (partition by diagnosis_id) top from dv) select diagnosis_id, step_index, score from g where top <= 0 or score < cast(0.85 as double) * top",
    "plateau_islands": f"with {DIV}, a as (select *, case when step_index - lag(step_index) over w = 1 and abs(score - lag(score) over w) <= cast(0.05 as double) then 0 else 1 end fresh from dv window w as (partition by diagnosis_id order by step_index)), g as (select *, sum(fresh) over (partition by diagnosis_id order by step_index) island from a) select diagnosis_id, min(step_index) step_index, max(score) score, count(*) members from g group by diagnosis_id, island",
    "divergence_top": f"with {DIV}, r as (select *, row_number() over (partition by diagnosis_id order by score desc, step_index) k from dv) select diagnosis_id, step_index, score, k rank_in_trace from r where k <= 5",
    # candidates and verdicts
    "assemble_diagnoses": f"with {DIAG}, {DIV}, c as (select diagnosis_id, count(*) n, max(score) top from dv group by diagnosis_id) select dg.diagnosis_id, dg.trace_id, dg.failure_class, coalesce(c.n, 0) divergences, c.top from dg left join c on dg.diagnosis_id = c.diagnosis_id",
    # clusters over runs
    "cluster_label_states": "select cluster_id, label, medoid_diagnosis_id, labeled_size from clusters where label is not null",
    "cluster_classes": f"with {DIAG}, h as (select cluster_id, failure_class, count(*) n from dg where cluster_id is not null group by cluster_id, failure_class) select cluster_id, failure_class, n, row_number() over (partition by cluster_id order by n desc, failure_class nulls last) k from h",
    # evaluation
    "read_trace": f"with {SPANS} select trace_id, span_id, parent_span_id, kind, status, start_ns from sp",
    # texts
    "token_sets": "with a as (select doc_id, |words text| w from documents where text is not null) select doc_id, |size w| distinct_words from a",
    "mask_ids": "select doc_id, sha1(|sub text ~ [0-9A-Za-z_]*[0-9][0-9A-Za-z_]* ~ <ID>|) masked_sha1 from documents where text is not null",
    "truncate_excerpt": "select doc_id, case when length(text) <= 400 then text else concat(substr(text, 1, 198), ' ... ', |tail text ~ 197|) end excerpt from documents",
}
