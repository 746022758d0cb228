"""Queries of the problems that are not about language models: p2 to p5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import drift, hierarchy, instants, nested
from faultline.operators.shred import shred
from faultline.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    records, sources = table(spark, d, "raw_records"), table(spark, d, "upload_sources").select("source", "time_zone", "day_month_order")
    spans = nested.shred_records(records, ["spanId", "span_id", "start_time", "startTimeUnixNano", "timestamp"], [nested.OI_SPANS, nested.TOP_SPANS, nested.CHILD_SPANS], ("received_at",)).where("not is_null")
    f = F.col("fields")
    spans = spans.select("record_id", "source", "received_at", F.coalesce(f["span_id"], f["spanId"]).alias("span_id"), F.coalesce(f["start_time"], f["startTimeUnixNano"], f["timestamp"]).alias("start"))
    return instants.read_instants(spans.where("span_id is not null"), "start", sources, "source", "received_at", "record_id").where("start_us is not null").select("record_id", "span_id", "start_us")


def p2_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The zone of every source as its values alone show it among all candidates, next to the declared one."""
    records, sources = table(spark, d, "raw_records"), table(spark, d, "upload_sources")
    spans = nested.shred_records(records, ["start_time", "startTimeUnixNano", "timestamp"], [nested.OI_SPANS, nested.TOP_SPANS, nested.CHILD_SPANS], ("received_at",)).where("not is_null")
    f = F.col("fields")
    order = sources.groupBy(instants.canonical_source(F.col("source")).alias("__source")).agg(F.max("day_month_order").alias("__order"), F.max("time_zone").alias("declared_zone"))
    read = spans.select("record_id", "received_at", instants.canonical_source(F.col("source")).alias("__source"), F.coalesce(f["start_time"], f["startTimeUnixNano"], f["timestamp"]).alias("start")).join(order, "__source", "left")
    lines = instants.record_lines(instants.parse_instant(read, "start", "__order"), "received_at", "record_id")
    best = instants.estimate_zones(lines.where("__source is not null"), F.array(*map(F.lit, instants.candidates(spark))))
    return best.join(order, "__source", "left").select(F.col("__source").alias("source"), F.col("zone").alias("estimated_zone"), "declared_zone", "violations", "values")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.load_lines(table(spark, d, "payload_files")))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """Every record of payload_files as LlmPayload columns."""
    return drift.unify(table(spark, d, "payload_files"))[0]


def p3_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "payload_files"))[2]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.links(table(spark, d, "raw_records"))


def p4_spans(spark: SparkSession, d: str) -> DataFrame:
    return nested.span_table(table(spark, d, "raw_records")).drop("ordinals")


def p4_messages(spark: SparkSession, d: str) -> DataFrame:
    return nested.message_table(table(spark, d, "raw_records"))


def p4_parts(spark: SparkSession, d: str) -> DataFrame:
    return nested.part_table(table(spark, d, "raw_records"))


GROUP = ["source_kind", "trace_id"]


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """The distinct spans of spans and of the trail bodies with their parents."""
    own = table(spark, d, "spans").select(F.lit("spans").alias("source_kind"), hierarchy.clean_id(F.col("trace_id")).alias("trace_id"), hierarchy.clean_id(F.col("span_id")).alias("id"), hierarchy.clean_parent(F.col("parent_span_id")).alias("parent"))
    records = table(spark, d, "raw_records").where("layout = 'trail'").select("record_id", "body")
    rows = shred(records, ["record_id"], "body", ["spans", "child_spans"], ["span_id", "parent_span_id", "trace_id"], ["spans", "spans/child_spans"], link=["span_id"]).where("not is_null")
    f = F.col("fields")
    trail = rows.select(F.lit("trail").alias("source_kind"), hierarchy.clean_id(f["trace_id"]).alias("trace_id"), hierarchy.clean_id(f["span_id"]).alias("id"), F.coalesce(hierarchy.clean_parent(f["parent_span_id"]), hierarchy.clean_parent(F.col("parent_key"))).alias("parent"))
    return hierarchy.distinct_nodes(own.unionByName(trail), GROUP, "id", "parent")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_nodes(spark, d), GROUP).select(*GROUP, F.col("node").alias("span_id"), F.col("root_id").alias("root_span_id"), "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, subtree size and chain of every span."""
    solved = hierarchy.hierarchy(_nodes(spark, d), GROUP, with_path=True)
    return solved.select(*GROUP, F.col("node").alias("span_id"), F.col("root_id").alias("root_span_id"), "depth", F.array_join("path", "/").alias("path"), F.when(F.col("depth") >= 0, F.col("subtree_size") - 1).alias("descendant_count"), F.col("head_id").alias("chain_id"), F.col("position").alias("chain_position"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    solved = hierarchy.hierarchy(_nodes(spark, d), GROUP)
    return hierarchy.descendants(solved, GROUP).select(*GROUP, F.col("node").alias("span_id"), F.col("descendant").alias("descendant_span_id"), "distance")


def p5_circles(spark: SparkSession, d: str) -> DataFrame:
    """Per trace with circular links the number of spans on a circle or below one."""
    solved = hierarchy.hierarchy(_nodes(spark, d), GROUP)
    return solved.where("depth < 0").groupBy(*GROUP).agg(F.count("*").alias("spans_on_or_below_circles"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_zone_estimates, p3_found, p3_table, p3_failed_casts, p4_found, p4_spans, p4_messages, p4_parts, p5_found, p5_paths, p5_descendants, p5_circles)}

#: Equivalent SQL where SQL can say it.
SQL: dict[str, str] = {
    "p5_found": """
with recursive own as (select 'spans' source_kind, lower(trim(trace_id)) trace_id, lower(trim(span_id)) id, case when coalesce(trim(parent_span_id), '') <> '' then lower(trim(parent_span_id)) end parent from spans),
bodies as (select json(ltrim(body, chr(65279))) j from raw_records where layout = 'trail' and json_valid(ltrim(body, chr(65279)))),
lists as (select case json_type(j, '$.spans') when 'ARRAY' then json_extract(j, '$.spans[*]') when 'OBJECT' then [json_extract(j, '$.spans')] else [] end l from bodies),
tree(node, inside) as (select unnest(l), cast(null as varchar) from lists
 union all select unnest(case json_type(node, '$.child_spans') when 'ARRAY' then json_extract(node, '$.child_spans[*]') when 'OBJECT' then [json_extract(node, '$.child_spans')] else [] end), coalesce(json_extract_string(node, '$.span_id'), inside) from tree),
trail as (select 'trail' source_kind, lower(trim(json_extract_string(node, '$.trace_id'))) trace_id, lower(trim(json_extract_string(node, '$.span_id'))) id,
 coalesce(case when coalesce(trim(json_extract_string(node, '$.parent_span_id')), '') <> '' then lower(trim(json_extract_string(node, '$.parent_span_id'))) end, lower(inside)) parent from tree where json_type(node) = 'OBJECT'),
nodes as (select source_kind, trace_id, id, min(parent) parent from (select * from own union all select * from trail) where id is not null group by all),
up as (select n.*, p.id up from nodes n left join nodes p on n.source_kind = p.source_kind and n.trace_id = p.trace_id and n.parent = p.id),
walk as (select source_kind, trace_id, id, id root, 0 depth from up where up is null
 union all select c.source_kind, c.trace_id, c.id, w.root, w.depth + 1 from up c join walk w on c.source_kind = w.source_kind and c.trace_id = w.trace_id and c.up = w.id)
select n.source_kind, n.trace_id, n.id span_id, coalesce(w.root, '') root_span_id, coalesce(w.depth, -1) depth from nodes n left join walk w using (source_kind, trace_id, id)""",
}

_WALK = SQL["p5_found"]
SQL["p5_descendants"] = _WALK.rpartition("\nselect n.source_kind")[0] + """,
pairs as (select u.source_kind, u.trace_id, u.id, u.up node, 1 distance from up u join walk w using (source_kind, trace_id, id) where u.up is not null
 union all select p.source_kind, p.trace_id, p.id, u.up, p.distance + 1 from pairs p join up u on u.source_kind = p.source_kind and u.trace_id = p.trace_id and u.id = p.node where u.up is not null)
select source_kind, trace_id, node span_id, id descendant_span_id, distance from pairs"""
SQL["p5_circles"] = f"select source_kind, trace_id, count(*) spans_on_or_below_circles from ({_WALK}) where depth < 0 group by all"
_CHILDREN = "unnest(case json_type({0}, '$.{1}') when 'ARRAY' then json_extract({0}, '$.{1}[*]') when 'OBJECT' then [json_extract({0}, '$.{1}')] else [] end)"
_PLACES = "unnest(range(cast(case json_type({0}, '$.{1}') when 'ARRAY' then json_array_length({0}, '$.{1}') when 'OBJECT' then 1 else 0 end as bigint)))"
SQL["p4_found"] = f"""
with recursive bodies as (select record_id, layout, json(ltrim(body, chr(65279))) j from raw_records where json_valid(ltrim(body, chr(65279)))),
r as (select record_id, {_CHILDREN.format('j', 'resourceSpans')} n, {_PLACES.format('j', 'resourceSpans')} a from bodies where layout = 'openinference'),
s as (select record_id, a, {_CHILDREN.format('n', 'scopeSpans')} n, {_PLACES.format('n', 'scopeSpans')} b from r),
o as (select record_id, a, b, {_CHILDREN.format('n', 'spans')} n from s),
tree(record_id, node, inside) as (select record_id, {_CHILDREN.format('j', 'spans')}, '' from bodies where layout = 'trail'
 union all select record_id, {_CHILDREN.format('node', 'child_spans')}, coalesce(json_extract_string(node, '$.span_id'), inside) from tree),
u as (select record_id, {_CHILDREN.format('j', 'spans')} n from bodies where layout = 'raw_upload'),
m as (select record_id, coalesce(json_extract_string(n, '$.span_id'), '') p, {_CHILDREN.format('n', 'attributes.request_messages')} n, {_PLACES.format('n', 'attributes.request_messages')} i from u),
c as (select record_id, p, i, {_CHILDREN.format('n', 'content')} n, {_PLACES.format('n', 'content')} k from m where json_type(n) = 'OBJECT')
select record_id, 'span' child_kind, concat(a, '/', b) parent_key, json_extract_string(n, '$.spanId') child_key from o where json_extract_string(n, '$.spanId') is not null
union all select record_id, 'child_span', inside, json_extract_string(node, '$.span_id') from tree where json_extract_string(node, '$.span_id') is not null
union all select record_id, 'message', p, cast(i as varchar) from m where json_type(n) <> 'NULL'
union all select record_id, 'part', concat(p, '/', i), cast(k as varchar) from c where json_type(n) <> 'NULL'"""
