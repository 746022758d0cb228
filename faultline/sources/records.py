"""Bodies of any layout to raw spans, and bodies to ingested traces: header, spans and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import linearize, shred
from faultline.runtime import cut
from faultline.sources import vocabularies
from faultline.sources.turns import iso_duration_ns

# What a payload's content type may be.
CONTENT_TYPES = {"application/json": "json", "application/x-protobuf": "protobuf"}

# What a goal's digest masks, in this order.
MASKS = [
    (r"https?://\S+", "<url>"), (r"[\w.+-]+@[\w.-]+\.\w+", "<email>"), (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "<date>"), (r"\b\d+\b", "<int>"),
]

_KEEP = ["trace_id", "span_id", "parent_span_id", "name", "span_name", "kind", "status", "actor", "start_time", "end_time", "timestamp", "duration", "status_code", "status_message"]
_CODES = {"ok": "STATUS_CODE_OK", "error": "STATUS_CODE_ERROR", "unset": "STATUS_CODE_UNSET"}


def wire_format(content_type: Column) -> Column:
    """json or protobuf, whatever the letter case and parameters of the content type; null for a type that is not supported."""
    bare = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))[bare]


def nested_spans(records: DataFrame, key: str, body: str, trail: bool) -> DataFrame:
    """Raw spans of direct uploads or of trail records (trail): key, ord and the columns that normalize reads.

    The attributes object stays one JSON text. A span without a trace_id of its own takes the body's.
    """
    spot = "span_attributes" if trail else "attributes"
    head = F.get_json_object(F.regexp_replace(F.col(body), "^\ufeff+", ""), "$.trace_id").alias("__body_trace")
    df = records.select(F.col(key).alias("__key"), head, F.col(body).alias("__text"))
    rows = shred.shred(df, ["__key", "__body_trace"], "__text", ["spans", "child_spans"] if trail else ["spans"], _KEEP, ["spans", "spans/child_spans"], link=["span_id"], whole=[spot]).where("not is_null")
    f = F.col("fields")
    start = vocabularies.iso_ns(f["timestamp"])
    return rows.select(
        F.col("__key").alias(key), "ordinals", F.coalesce(f["trace_id"], F.col("__body_trace")).alias("trace_id"), f["span_id"].alias("span_id"), F.coalesce(F.nullif(f["parent_span_id"], F.lit("")), F.col("parent_key") if trail else F.lit(None)).alias("parent_span_id"),
        F.coalesce(f["name"], f["span_name"]).alias("name"), F.when(F.lit(not trail), f["kind"]).alias("kind"), F.when(F.lit(not trail), f["status"]).alias("status"), f["actor"].alias("actor"), f["start_time"].alias("start_time"), f["end_time"].alias("end_time"),
        F.when(F.lit(trail), start).alias("start_ns"), F.when(F.lit(trail), start + iso_duration_ns(f["duration"])).alias("end_ns"),
        F.when(F.lit(trail), vocabularies._lookup(F.lower(F.coalesce(f["status_code"], F.lit(""))), _CODES, "STATUS_CODE_UNSET")).alias("status_code"), f["status_message"].alias("status_message"), f[spot].alias("attributes"),
    )


def masked_task_key(goal: Column) -> Column:
    """sha1 of a goal without its urls, mail addresses, UUIDs, dates and numbers; a null goal is an empty one."""
    g = F.lower(F.coalesce(goal, F.lit("")))
    for pattern, mask in MASKS:
        g = F.regexp_replace(g, "(?U)" + pattern, mask)
    return F.sha1(F.trim(F.regexp_replace(g, r"(?U)\s+", " ")))


def agent_keys(steps: DataFrame, frameworks: DataFrame) -> DataFrame:
    """trace_id, agent_key: sha1 over framework, sorted actors and sorted tools of a trace, joined by bars. frameworks: trace_id, framework, one row a trace."""
    part = F.split("signature", ":")
    tool = F.when(part[0] == "tool", part[2]).when((part[0] == "llm") & (F.get(part, F.lit(2)) == "call"), F.get(part, F.lit(3)))
    per = steps.groupBy(F.col("trace_id").alias("k_t")).agg(F.array_join(F.array_sort(F.collect_set("actor")), ",").alias("actors"), F.array_join(F.array_sort(F.collect_set(tool)), ",").alias("tools"))
    text = F.concat(F.coalesce("framework", F.lit("")), F.lit("|"), F.coalesce("actors", F.lit("")), F.lit("|"), F.coalesce("tools", F.lit("")))
    return frameworks.join(per, F.col("trace_id") == F.col("k_t"), "left").select("trace_id", F.sha1(text).alias("agent_key"))


def ingest(spans: DataFrame, headers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traces, spans, steps) of normalised spans with ord, their order in the payload.

    headers: trace_id, source, framework, task_goal, outcome of direct uploads; other traces come from OpenTelemetry: failed if any
    span did, and about the first agent's input, else the first user message. An outcome that is none is unknown.
    """
    spans = cut(spans.where("trace_id is not null"))
    steps = cut(linearize.linearize(spans))
    p = F.col("p")
    user = F.get(F.filter(p["request_messages"], lambda m: (m["role"] == "user") & (F.coalesce(m["content"], F.lit("")) != "")), F.lit(0))["content"]
    first = lambda cond, what: F.min(F.when(cond, F.struct("ord", what.alias("x"))))["x"]
    own = spans.groupBy("trace_id").agg(
        F.max(F.when(F.col("status") == "error", 1).otherwise(0)).alias("failed"),
        F.coalesce(first((F.col("kind") == "agent") & (F.coalesce(p["input_text"], F.lit("")) != ""), p["input_text"]), first((F.col("kind") == "llm") & user.isNotNull(), user)).alias("goal"),
        F.coalesce(first(F.col("parent_span_id").isNull(), F.col("span_id")), F.min(F.struct("ord", "span_id"))["span_id"]).alias("root_span_id"), F.count("*").cast("int").alias("span_count"),
    )
    counts = steps.groupBy(F.col("trace_id").alias("c_t")).agg(F.count("*").cast("int").alias("step_count"))
    lost = linearize.place(spans).where("is_orphan").groupBy(F.col("trace_id").alias("o_t")).agg(F.array_sort(F.collect_set("node")).alias("orphan_span_ids"))
    t = own.join(counts, F.lower(F.trim("trace_id")) == F.col("c_t"), "left").join(lost, F.lower(F.trim("trace_id")) == F.col("o_t"), "left")
    if headers is None:
        t = t.select("*", *(F.lit(None).cast("string").alias(c) for c in ("h_source", "h_framework", "h_goal", "h_outcome")), F.lit(None).cast("string").alias("h_t"))
    else:
        h = headers.groupBy(F.col("trace_id").alias("h_t")).agg(F.max(F.struct("source", "framework", "task_goal", "outcome")).alias("h"))
        t = t.join(h.select("h_t", F.col("h.source").alias("h_source"), F.col("h.framework").alias("h_framework"), F.col("h.task_goal").alias("h_goal"), F.col("h.outcome").alias("h_outcome")), F.col("trace_id") == F.col("h_t"), "left")
    sent = F.col("h_t").isNotNull()
    t = t.select(
        "trace_id", F.when(sent, F.coalesce(F.nullif("h_source", F.lit("")), F.lit("manual_upload"))).otherwise("otlp").alias("source"), F.col("h_framework").alias("framework"),
        F.when(sent, F.col("h_goal")).otherwise(F.col("goal")).alias("task_goal"), F.when(~sent, F.when(F.col("failed") == 1, "failure").otherwise("success")).when(F.col("h_outcome").isin("success", "failure"), F.col("h_outcome")).otherwise("unknown").alias("outcome"),
        "root_span_id", "span_count", F.coalesce("step_count", F.lit(0)).alias("step_count"), F.coalesce("orphan_span_ids", F.array().cast("array<string>")).alias("orphan_span_ids"),
    )
    t = cut(t)
    keys = agent_keys(steps, t.select(F.lower(F.trim("trace_id")).alias("trace_id"), "framework")).select(F.col("trace_id").alias("a_t"), "agent_key")
    return t.join(keys, F.lower(F.trim("trace_id")) == F.col("a_t"), "left").drop("a_t").withColumn("task_key", masked_task_key(F.col("task_goal"))), spans, steps


def upload_headers(records: DataFrame, body: str) -> DataFrame:
    """trace_id, source, framework, task_goal, outcome of direct uploads; a body without a trace_id is named by its digest."""
    text = F.regexp_replace(F.col(body), "^\ufeff+", "")
    g = lambda k: F.get_json_object(text, f"$.{k}")
    return records.where(F.try_parse_json(text).isNotNull()).select(F.coalesce(F.nullif(g("trace_id"), F.lit("")), F.sha1(text)).alias("trace_id"), g("source").alias("source"), g("framework").alias("framework"), g("task_goal").alias("task_goal"), g("outcome").alias("outcome"))


__all__ = ["agent_keys", "ingest", "masked_task_key", "nested_spans", "upload_headers", "wire_format"]
