"""Queries of recurring failures: cards, medoids, spread samples, identities, flags of signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import detectors, groups, steps, store
from faultline.plans import relational, step_oracles
from faultline.plans.judge_queries import diagnoses
from faultline.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def diagnosis_cards(spark: SparkSession, d: str) -> DataFrame:
    """The masked card of every diagnosis."""
    g = table(spark, d, "diagnoses").where("diagnosis_id is not null").groupBy("diagnosis_id").agg(F.max(F.struct("created_at", "confidence", "cluster_id", "trace_id", "root_cause_step_index", "failure_class", "rationale")).alias("r")).select("diagnosis_id", "r.trace_id", "r.root_cause_step_index", "r.failure_class", "r.rationale")
    v = table(spark, d, "divergences").where("diagnosis_id is not null and step_index is not null").groupBy("diagnosis_id", "step_index").agg(F.min("observed_signature").alias("observed_signature"), F.min("expected_signatures").alias("e"))
    v = v.withColumn("expected", F.get_json_object("e", "$[0][0]")).drop("e")
    found = detectors.signals(steps.enrich(*(table(spark, d, t) for t in ("steps", "spans", "traces"))))
    return groups.cards(g, v, found)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("v"))


def group_medoids(spark: SparkSession, d: str) -> DataFrame:
    return groups.medoids(_labelled(spark, d))


def group_samples(spark: SparkSession, d: str) -> DataFrame:
    m = _labelled(spark, d)
    return groups.spread_sample(m, groups.medoids(m))


def cluster_identity(spark: SparkSession, d: str) -> DataFrame:
    """Failure classes as new groups of the diagnoses, against the clusters of earlier runs."""
    known = table(spark, d, "clusters").select(F.col("cluster_id").alias("k")).distinct()
    g = diagnoses(spark, d).where("failure_class is not null").join(known, F.col("cluster_id") == F.col("k"), "left")
    return groups.identities(g.select(F.col("diagnosis_id").alias("id"), F.col("failure_class").alias("label"), F.col("k").alias("previous"))).select("label", "size", F.when(F.col("reused"), F.col("cluster_id")).alias("reused_cluster_id"))


def needs_relabel(spark: SparkSession, d: str) -> DataFrame:
    """Which clusters need a new label, their present medoid being the smallest id of their members."""
    now = diagnoses(spark, d).where("cluster_id is not null").groupBy("cluster_id").agg(F.min("diagnosis_id").alias("medoid"), F.count("*").alias("size"))
    states = table(spark, d, "clusters").select("cluster_id", "label", F.col("medoid_diagnosis_id").alias("medoid"), "labeled_size")
    return groups.needs_relabel(now, states)


def signature_flags(spark: SparkSession, d: str) -> DataFrame:
    """Signatures with the flags of their payloads."""
    e = steps.enrich(*(table(spark, d, t) for t in ("steps", "spans", "traces")))
    return e.select("trace_id", "step_index", groups.flagged_signature(F.col("signature"), F.col("kind"), F.col("p")).alias("token"))


def prune_attributes(spark: SparkSession, d: str) -> DataFrame:
    """How many spans lose their attributes if what was ingested more than 90 days before the last trace is pruned."""
    traces = table(spark, d, "traces")
    newest = traces.agg(F.max("ingested_at")).first()[0]
    kept = traces.where("trace_id is not null").groupBy("trace_id").agg(F.max("ingested_at").alias("ingested_at"))
    done = store.prune_attributes(table(spark, d, "spans"), kept, 90, newest)
    return done.groupBy("attributes_pruned").agg(F.count("*").alias("spans"), F.sum((F.col("attributes") == "{}").cast("int")).alias("empty"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (diagnosis_cards, group_medoids, group_samples, cluster_identity, needs_relabel, signature_flags, prune_attributes)}

_MASKED = r"regexp_replace(regexp_replace(regexp_replace({0}, '\b[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}\b', '<UUID>', 'g'), '\b\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?Z?)?\b', '<DATE>', 'g'), '\b\w*\d\w*\b', '<ID>', 'g')"
_UNIT = "u as (select vec_id id, cast(label as integer) label, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) u from embeddings), c as (select label, ix, avg(x) x from (select label, unnest(u) x, unnest(range(len(u))) ix from u) group by all), m as (select label, list(x order by ix) c from c group by label), k as (select u.*, row_number() over (partition by u.label order by round(list_distance(u.u, m.c), 9), id) r, count(*) over (partition by u.label) n from u join m using (label))"
SQL: dict[str, str] = {
    "diagnosis_cards": f"""with l1 as (select * from ({step_oracles.ALL})), {relational.DIAG}, v as (select diagnosis_id, step_index, min(observed_signature) o, json_extract_string(min(expected_signatures), '$[0][0]') e from divergences where diagnosis_id is not null and step_index is not null group by 1, 2),
s as (select dg.diagnosis_id, first(o order by v.step_index is distinct from dg.root_cause_step_index, v.step_index) o, first(e order by e is null, v.step_index is distinct from dg.root_cause_step_index, v.step_index) e from dg join v using (diagnosis_id) group by 1),
n as (select trace_id, string_agg(distinct detector, ', ' order by detector) names from l1 group by 1)
select diagnosis_id, {_MASKED.format("'failure_class: ' || coalesce(failure_class, 'unknown') || chr(10) || 'observed: ' || coalesce(o, '') || chr(10) || 'expected: ' || coalesce(e, '') || chr(10) || 'detectors: ' || coalesce(names, '') || chr(10) || 'rationale: ' || substr(coalesce(rationale, ''), 1, 300)")} card from dg left join s using (diagnosis_id) left join n using (trace_id)""",
    "group_medoids": f"with {_UNIT} select label, id medoid, n size from k where r = 1",
    "group_samples": f"""with {_UNIT}, b as (select label, id, u from k where r = 1), f as (select u.label, u.id, row_number() over (partition by u.label order by round(list_distance(u.u, b.u), 9), u.id) - 1 ix, count(*) over (partition by u.label) n from u join b using (label) where u.id <> b.id)
select label, id, 0 place from b union all select label, id, cast(ix // greatest(1, n // 4) + 1 as integer) from f where ix % greatest(1, n // 4) = 0 and ix // greatest(1, n // 4) < 4""",
    "cluster_identity": f"with {relational.DIAG}, a as (select diagnosis_id, failure_class label, cluster_id prev from dg where failure_class is not null), s as (select label, count(*) n from a group by label), v as (select a.label, a.prev, count(*) c from a join clusters k on a.prev = k.cluster_id group by a.label, a.prev), b as (select v.*, s.n, row_number() over (partition by v.label order by c desc, prev desc) k1 from v join s on v.label = s.label), m as (select * from b where k1 = 1 and 2 * c > n), u as (select *, row_number() over (partition by prev order by c desc, label) k2 from m) select s.label, s.n size, u.prev reused_cluster_id from s left join (select * from u where k2 = 1) u on s.label = u.label",
    "needs_relabel": f"with {relational.DIAG}, m as (select cluster_id, min(diagnosis_id) medoid, count(*) size from dg where cluster_id is not null group by 1), s as (select cluster_id, any_value(medoid_diagnosis_id) md, any_value(labeled_size) ls from clusters where label is not null group by 1) select m.*, s.cluster_id is null or md is distinct from medoid or coalesce(ls > 0 and size > 1.5 * ls, false) relabel from m left join s using (cluster_id)",
    "signature_flags": step_oracles.BASE + """, w as (select *, len(list_filter(string_split_regex(coalesce(json_extract_string(p, '$.query'), ''), '\\s+'), lambda z: z <> '')) words, list_filter(list_transform(json_extract_string(p, '$.documents[*].score'), lambda z: cast(z as double)), lambda z: z is not null) sc from x),
f as (select *, array_to_string(list_sort(list_filter([case when kind = 'tool' and not is_error and coalesce(arguments_json, '') not in ('', '{}') and not coalesce(json_valid(arguments_json) and json_type(arguments_json) = 'OBJECT', false) then 'argsmalformed' end,
 case when kind = 'llm' and json_extract_string(p, '$.response_format_schema') is not null and not coalesce(json_valid(json_extract_string(p, '$.response_messages[0].content')), false) then 'schemaviolation' end, case when kind = 'llm' and max_tokens > 0 and total_tokens >= 0.9::double * max_tokens then 'neartokenlimit' end,
 case when kind = 'retriever' and not contains(signature, concat('w', words, ':')) then 'querydrift' end, case when kind = 'retriever' and len(sc) > 0 and list_avg(sc) < 0.3 then 'lowscore' end, case when kind = 'agent' and json_array_length(p, '$.delegated_to') > 1 then concat('delegates', json_array_length(p, '$.delegated_to')) end], lambda z: z is not null)), ',') flags from w)
select trace_id, step_index, case when p is not null and flags <> '' then signature || '|' || flags else signature end token from f""",
    "prune_attributes": "with t as (select trace_id, max(ingested_at) i from traces where trace_id is not null group by 1), o as (select trace_id from t where i < (select max(ingested_at) from traces) - interval 90 days), s as (select o.trace_id is not null hit, coalesce(attributes_pruned, false) before, attributes from spans left join o on spans.trace_id = o.trace_id) select hit or before attributes_pruned, count(*) spans, sum(case when hit or attributes = '{}' then 1 when attributes is null then null else 0 end)::bigint empty from s group by 1",
}
