"""Queries of the engine's own operators over the trace tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import adjudicate, align, context, density, detectors, linearize, ranking, steps
from faultline.plans import relational, step_oracles
from faultline.plans.judge_queries import rank_candidates
from faultline.runtime import table
from faultline.sources import otlp
from faultline.streaming import signals as windows

Query = Callable[[SparkSession, str], DataFrame]


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return steps.enrich(table(spark, d, "steps"), table(spark, d, "spans"), table(spark, d, "traces"))


def _detector(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return detectors.signals(enriched(spark, d), [name])

    return run


def l1_signals(spark: SparkSession, d: str) -> DataFrame:
    """All signals of all traces."""
    return detectors.signals(enriched(spark, d))


QUERIES: dict[str, Query] = {**{f"detector_{n}": _detector(n) for n in detectors.DETECTORS}, "l1_signals": l1_signals}
SQL: dict[str, str] = {f"detector_{k}": v for k, v in step_oracles.SQL.items()}


def _plan(plan: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return relational.run(spark, d, plan)

    return run


QUERIES |= {k: _plan(v) for k, v in relational.PLANS.items()}
SQL["l1_signals"] = step_oracles.ALL
SQL |= {k: relational.duck(v) for k, v in relational.PLANS.items()}


def contrast_runs(spark: SparkSession, d: str) -> DataFrame:
    """Where every failed run leaves the successful runs of the most similar tasks."""
    traces = table(spark, d, "traces")
    last = F.max(F.struct("ingested_at", "task_embedding"))
    vectors = traces.where("trace_id is not null").groupBy(F.col("trace_id").alias("id")).agg(last["task_embedding"].alias("v"))
    return align.contrast_all(enriched(spark, d), steps.latest_traces(traces), vectors)


def linearized_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps out of the span trees."""
    made = linearize.linearize(table(spark, d, "spans"))
    return made.withColumn("collapsed_span_ids", F.array_join("collapsed_span_ids", ","))


def orphan_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans that hang under the root in place of the parent they name."""
    return linearize.place(table(spark, d, "spans")).where("is_orphan").select("trace_id", F.col("node").alias("span_id"))


def otlp_spans(spark: SparkSession, d: str) -> DataFrame:
    """Raw spans of the OpenTelemetry bodies."""
    return otlp.decode(table(spark, d, "raw_records").where("layout = 'openinference'"), "body", "record_id")


def failing_windows(spark: SparkSession, d: str) -> DataFrame:
    """The stream's window counts, over the whole table at once."""
    return windows.failing_by_window(table(spark, d, "spans").select("trace_id", "span_id", "kind", "status", "start_ns"))


def adjudicate_stub(spark: SparkSession, d: str) -> DataFrame:
    """Every ranked candidate judged by a fixed stand-in for the model."""
    ranked = rank_candidates(spark, d)
    prompts = ranked.select(F.concat_ws(":", "diagnosis_id", F.col("step_index").cast("string")).alias("key"), F.concat_ws(" ", F.lit("candidate"), "source", F.col("prior").cast("string")).alias("prompt"))
    return adjudicate.adjudicate(prompts, _stub, parallel=8).select("key", "is_root_cause", "confidence", "error")


def _stub(prompt: str) -> str:
    prior = float(prompt.split()[-1])
    return '```json\n{"is_root_cause": %s, "failure_class": "unknown", "confidence": %.4f}\n```' % (str(prior > 0.5).lower(), min(1.0, max(0.0, prior)))


QUERIES |= {f.__name__: f for f in (contrast_runs, linearized_steps, orphan_spans, otlp_spans, failing_windows, adjudicate_stub)}
SQL["failing_windows"] = "with s as (select trace_id, span_id, min(kind) kind, min(status) status, min(start_ns) start_ns from spans group by 1, 2) select start_ns // 1000 // 600000000 * 600000000 window_start_us, kind, count(*) spans, count(case when status = 'error' then 1 end) failing from s group by 1, 2"


def context_packets(spark: SparkSession, d: str) -> DataFrame:
    """Size of the packet of every ranked candidate."""
    ranked = rank_candidates(spark, d)
    traces = table(spark, d, "diagnoses").groupBy("diagnosis_id").agg(F.max("trace_id").alias("trace_id"))
    keyed = ranked.join(traces, "diagnosis_id").select(F.concat_ws(":", "diagnosis_id", F.col("step_index").cast("string")).alias("key"), "trace_id", "step_index")
    made = context.packets(keyed, steps.distinct_steps(table(spark, d, "steps")), steps.latest_traces(table(spark, d, "traces")))
    return made.select("key", F.size("visible").alias("visible_steps"), "tokens")


def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of the labelled vectors, each label a bounded set of its own."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_pylist()
        order = np.argsort(ids)
        labels = density.hdbscan(np.array(t.column("embedding").to_pylist(), float)[order], 5)
        return pa.table({"label": pa.array([key[0].as_py()] * len(ids), pa.int32()), "vec_id": pa.array([ids[i] for i in order], pa.int64()), "cluster": pa.array(labels, pa.int32())})

    return table(spark, d, "embeddings").select(F.col("label").cast("int").alias("label"), "vec_id", "embedding").groupBy("label").applyInArrow(run, "label int, vec_id long, cluster int")


_EMPTY = "('', '[]', '{}', 'null', 'no results found')"
_PLACED = f"""
with recursive f0 as (select lower(trim(trace_id)) t, lower(trim(span_id)) n, case when lower(trim(parent_span_id)) not in ('', 'null', 'none', 'nil', 'n/a', '-', '0', 'undefined') and not regexp_full_match(lower(trim(parent_span_id)), '(0x)?0+') then lower(trim(parent_span_id)) end pa, kind, status, name, start_ns, end_ns, payload
  from spans where trace_id is not null and span_id is not null),
f1 as (select t, n, min(pa) pa, min(kind) kind, min(status) status, min(name) nm, coalesce(min(start_ns), 0) b, coalesce(min(end_ns), 0) e, min(payload) p from f0 group by t, n),
f as (select * from f1 where t in (select t from f1 where kind in ('llm', 'tool', 'retriever', 'agent'))),
rt as (select t, n root from (select *, row_number() over (partition by t order by pa is not null, b, n) k from f) where k = 1),
u as (select f.*, rt.root, case when f.n = rt.root then null else coalesce(x.n, rt.root) end up, f.n <> rt.root and x.n is null hung from f join rt using (t) left join f x on x.t = f.t and x.n = f.pa and f.pa <> f.n),
ok(t, n) as (select t, n from u where n = root union all select c.t, c.n from u c join ok on c.t = ok.t and c.up = ok.n),
bad as (select u.t, u.n, u.up, u.b from u anti join ok using (t, n)),
reach(t, n, a) as (select t, n, up from bad union select r.t, r.n, bad.up from reach r join bad on bad.t = r.t and bad.n = r.a),
ring as (select r.t, r.n, min(struct_pack(b := o.b, n := o.n)) first from reach r join reach back on back.t = r.t and back.n = r.a and back.a = r.n join bad o on o.t = r.t and o.n = r.a group by r.t, r.n),
v as (select u.*, coalesce(ring.n = ring.first.n, false) led from u left join ring using (t, n)),
w as (select * replace (case when led then root else up end as up), hung or led orphan from v),
s as (select *, row_number() over (partition by t, up order by b, n) - 1 i,
  case when kind = 'agent' and p is not null then coalesce(json_extract_string(p, '$.agent_name'), 'unknown') when n = root then coalesce(nullif(nm, ''), 'unknown') end said from w),
tree as (select t, n, 0 depth, [i] path, said actor from s where n = root union all select c.t, c.n, tree.depth + 1, list_append(tree.path, c.i), coalesce(c.said, tree.actor) from s c join tree on c.t = tree.t and c.up = tree.n),
line as (select s.*, tree.depth, tree.path, tree.actor, row_number() over (partition by t order by tree.path) pre from s join tree using (t, n))
"""
SQL["orphan_spans"] = _PLACED + "select t trace_id, n span_id from line where orphan"
SQL["linearized_steps"] = _PLACED + f""", k as (select *, kind in ('llm', 'tool', 'retriever', 'agent') step from line),
m as (select *, coalesce(sum(case when step then 1 else 0 end) over (partition by t order by pre rows between unbounded preceding and 1 preceding), 0) before, sum(case when step then 1 else 0 end) over (partition by t) steps from k),
q as (select *, case when step then before else least(before, steps - 1) end idx from m),
h as (select t, idx, string_agg(n, ',' order by pre) ids from q where not step group by t, idx),
z as (select *, case when kind = 'llm' then min(case when kind = 'llm' then idx end) over (partition by t, actor) = idx end plan,
  json_extract_string(p, '$.tool_calls[0].tool_name') call, coalesce(json_array_length(p, '$.tool_calls'), 0) > 0 calls, case when p is null then coalesce(nm, '') else coalesce(json_extract_string(p, '$.tool_name'), '') end tool,
  case when p is null then 'ok' when json_extract_string(p, '$.is_error') = 'true' then 'err' when json_extract_string(p, '$.result_len') = '0' or lower(trim(coalesce(json_extract_string(p, '$.result_text'), ''))) in {_EMPTY} then 'empty' else 'ok' end outcome,
  len(list_filter(string_split_regex(coalesce(json_extract_string(p, '$.query'), ''), '\\s+'), lambda x: x <> '')) words, case when coalesce(json_array_length(p, '$.documents'), 0) > 0 then 'hit' else 'miss' end hit from q where step)
select t trace_id, cast(z.idx as integer) step_index, n span_id, kind, actor, depth, array_to_string(path, '.') tree_path,
 case when kind = 'agent' then concat('agent:', actor, ':invoke') when kind = 'llm' and calls then concat_ws(':', 'llm', actor, 'call', call) when kind = 'llm' then concat('llm:', actor, case when plan then ':plan' else ':answer' end)
  when kind = 'tool' then concat_ws(':', 'tool', actor, tool, outcome) else concat('retr:', actor, ':w', words, ':', hit) end signature,
 case when kind = 'agent' then actor || ' is invoked' when kind = 'llm' and calls then concat(actor, ' decides to call ', call) when kind = 'llm' then actor || case when plan then ' plans its next step' else ' responds' end
  when kind = 'tool' then concat(tool, ' returns ', outcome) else concat(actor, ' retrieves documents (', hit, ')') end summary,
 b start_ns, e end_ns, (e - b) / 1e6 duration_ms, coalesce(h.ids, '') collapsed_span_ids from z left join h using (t, idx)"""


QUERIES |= {f.__name__: f for f in (context_packets, density_clusters)}


def even_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred traces, evenly spread over their sorted ids."""
    ids = table(spark, d, "traces").select("trace_id").where("trace_id is not null").distinct()
    return ranking.even_sample(ids, "trace_id", 100).select("trace_id", F.col("position").cast("bigint").alias("i"))


def knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of every vector whose id is divisible by 50."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ranking.nearest_of(v.where("id % 50 = 0"), v, 5).select(F.col("id").alias("vec_id"), F.col("rank").alias("rank_of_neighbour"), F.round("cosine", 5).alias("cosine"))


QUERIES |= {f.__name__: f for f in (even_sample, knn_embeddings)}
SQL["even_sample"] = "with o as (select trace_id, row_number() over (order by trace_id) - 1 i, count(*) over () n from (select distinct trace_id from traces where trace_id is not null)) select trace_id, i from o where exists (select 1 from range(100) k(k) where o.i = k.k * o.n // 100)"
SQL["knn_embeddings"] = "with s as (select q.vec_id, e.vec_id other, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) c from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0), r as (select *, row_number() over (partition by vec_id order by c desc, other) k from s) select vec_id, k rank_of_neighbour, round(c, 5) cosine from r where k <= 5"
