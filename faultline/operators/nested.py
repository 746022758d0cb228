"""Flat tables of spans, messages and content parts out of the nested bodies of raw_records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.shred import shred

#: Keys at which the layouts have arrays.
ARRAYS = ["resourceSpans", "scopeSpans", "spans", "child_spans", "request_messages", "response_messages", "content", "errors"]
OI_SPANS = "resourceSpans/scopeSpans/spans"
TOP_SPANS = "spans"
CHILD_SPANS = "spans/child_spans"
MESSAGES = "spans/attributes.request_messages"
PARTS = "spans/attributes.request_messages/content"


def shred_records(records: DataFrame, keep: list[str] | None = None, groups: list[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """All groups of all bodies; each row with layout, group, ordinals, the key of its parent span and the columns carry of its record."""
    return shred(records, ["record_id", "layout", "source", *carry], "body", ARRAYS, keep, groups, link=["span_id", "spanId"])


def span_table(records: DataFrame) -> DataFrame:
    """One row per span of any layout: record_id, layout, span_id, parent_span_id, nested_in, name, kind, start, duration, ordinals."""
    keep = ["spanId", "span_id", "parentSpanId", "parent_span_id", "name", "span_name", "kind", "span_kind", "startTimeUnixNano", "start_time", "timestamp", "endTimeUnixNano", "end_time", "duration", "status", "status_code", "status.code", "trace_id", "traceId"]
    f = lambda *paths: F.coalesce(*(F.col("fields")[p] for p in paths))
    return (
        shred_records(records, keep, [OI_SPANS, TOP_SPANS, CHILD_SPANS])
        .where(~F.col("is_null") & (F.col("layout").eqNullSafe("openinference") == (F.col("group") == OI_SPANS)))
        .select(
            "record_id", "layout", "source", f("trace_id", "traceId").alias("trace_id"), f("span_id", "spanId").alias("span_id"), f("parent_span_id", "parentSpanId").alias("parent_span_id"),
            F.coalesce(F.col("parent_key"), F.lit("")).alias("nested_in"), f("name", "span_name").alias("name"), f("kind", "span_kind").alias("kind"),
            f("startTimeUnixNano", "start_time", "timestamp").alias("start"), f("endTimeUnixNano", "end_time").alias("end"), "ordinals",
        )
    )


def message_table(records: DataFrame) -> DataFrame:
    """One row per message: record_id, span_id, position, role, content where it is text."""
    return (
        shred_records(records, ["role", "content", "tool_call_id", "name"], [MESSAGES])
        .where(~F.col("is_null"))
        .select("record_id", F.col("parent_key").alias("span_id"), F.element_at("ordinals", -1).alias("position"), F.col("fields")["role"].alias("role"), F.col("fields")["content"].alias("content"), F.col("fields")["tool_call_id"].alias("tool_call_id"))
    )


def part_table(records: DataFrame) -> DataFrame:
    """One row per part of a message whose content is an array: record_id, span_id, message_position, position, type, text."""
    return (
        shred_records(records, ["type", "text", ""], [PARTS])
        .where(~F.col("is_null"))
        .select("record_id", F.col("parent_key").alias("span_id"), F.element_at("ordinals", -2).alias("message_position"), F.element_at("ordinals", -1).alias("position"), F.col("fields")["type"].alias("type"), F.coalesce(F.col("fields")["text"], F.col("fields")[""]).alias("text"))
    )


def links(records: DataFrame) -> DataFrame:
    """Every child row with its parent: record_id, child_kind, parent_key, child_key.

    Positions count from 0 and count null entries, which give no row. A record whose body is not JSON
    gives none. A span without an id gives no row, as nothing could name it.
    """
    rows = shred_records(records, ["spanId", "span_id"], [OI_SPANS, TOP_SPANS, CHILD_SPANS, MESSAGES, PARTS]).where(~F.col("is_null"))
    pos = lambda i: F.try_element_at(F.col("ordinals"), F.lit(i)).cast("string")
    is_group = lambda *names: F.col("group").isin(*names)
    layout = F.col("layout")
    kind = (
        F.when((layout == "openinference") & is_group(OI_SPANS), "span")
        .when((layout == "trail") & is_group(TOP_SPANS, CHILD_SPANS), "child_span")
        .when((layout == "raw_upload") & is_group(MESSAGES), "message")
        .when((layout == "raw_upload") & is_group(PARTS), "part")
    )
    above = F.coalesce(F.col("parent_key"), F.lit(""))
    parent = F.when(kind == "span", F.concat_ws("/", pos(1), pos(2))).when(kind == "part", F.concat_ws("/", above, pos(-2))).otherwise(above)
    child = F.when(kind == "span", F.col("fields")["spanId"]).when(kind == "child_span", F.col("fields")["span_id"]).otherwise(pos(-1))
    return rows.select("record_id", kind.alias("child_kind"), parent.alias("parent_key"), child.alias("child_key")).where("child_kind is not null and child_key is not null")
